"""Scalar functions on columns; every one is a Catalyst expression.

Null text counts as empty unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import settings as S


def text(c: Column | str) -> Column:
    """Trimmed text, empty for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(text(c), F.lit(""))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, list(tests), F.lit(False))


def contains_any(c: Column, markers) -> Column:
    return any_of(c.contains(m) for m in markers)


def starts_any(c: Column, prefixes) -> Column:
    return any_of(c.startswith(p) for p in prefixes)


def cases(pairs, default: Column) -> Column:
    """First value whose condition holds."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named; keeps generated code small."""
    return F.transform(F.array(value), use)[0]


# B1
_SCALAR_KEYS = ["string", "int", "long", "float", "double", "boolean", "uuid", "id", "name", "key", "path", "value", "ipAddress"]


def unwrap_scalar(json: Column | str) -> Column:
    """Scalar of an Avro-style union as JSON text: `{"string": x}` by key priority, the only entry of a one-entry object,
    the first useful element of an array, or the scalar itself; two levels deep. Empty if there is none."""

    def level(v: Column) -> Column:
        keyed = F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in _SCALAR_KEYS])
        only = let(F.from_json(v, "map<string,string>"), lambda m: F.when(F.size(F.map_keys(m)) == 1, F.get(F.map_values(m), F.lit(0))))
        element = F.coalesce(*[F.get_json_object(v, f"$[{i}]") for i in range(4)])
        return F.coalesce(F.when(v.startswith("{"), F.coalesce(keyed, only)).when(v.startswith("["), element).otherwise(v), F.lit(""))

    return let(let(text(json), level), level)


def first_non_empty(*cs: Column | str) -> Column:
    """First of several texts that is not blank, empty if all are."""
    return F.coalesce(F.get(F.filter(F.array(*[text(c) for c in cs]), lambda t: t != ""), F.lit(0)), F.lit(""))


# B2, B6
def normalize_action(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.replace(c, F.lit("EVENT_"), F.lit("")))


def normalize_event_type(c: Column | str) -> Column:
    """Canonical event type, the name itself if it has none, UNKNOWN if blank."""
    t = F.upper(text(c))
    names = F.create_map(*[F.lit(x) for kv in S.EVENT_TYPES.items() for x in kv])
    return F.when(t == "", F.lit("UNKNOWN")).otherwise(F.coalesce(F.element_at(names, t), t))


# B3
def to_epoch_seconds(c: Column | str) -> Column:
    """Seconds since 1970 of a number whose unit follows from its digits (18+: ns, 15+: us, 12+: ms, else s) or of an ISO text in UTC."""
    t = text(c)
    n = t.try_cast("double")
    digits = F.length(F.abs(n.try_cast("decimal(38,0)")).cast("string"))
    number = F.when(digits >= 18, n / 1e9).when(digits >= 15, n / 1e6).when(digits >= 12, n / 1e3).otherwise(n)
    stamp = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" "))))
    return F.coalesce(F.when(t.rlike(r"^[-+]?\d+(\.\d+)?$"), number), stamp.cast("double"))


def format_seconds(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in the session zone (keep it UTC); empty for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


# B4, B5
def normalize_node_type(c: Column | str) -> Column:
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return cases([(contains_any(t, ["process", "subject"]), "process"), (contains_any(t, ["netflow", "flow"]) | (t == "net"), "flow"),
                  (contains_any(t, ["registry", "file", "srcsink"]), "file"), (t.contains("memory"), "memory"),
                  (contains_any(t, ["pipe", "socket"]), "pipe"), (t == "", "object")], t)


def render_node(attr: Column, hint: Column, uuid: Column) -> Column:
    return F.coalesce(blank_to_null(attr), blank_to_null(hint), text(uuid))


# B7, B8, B14
def basename(path: Column | str) -> Column:
    """Last part of a path with either slash; the whole text if it consists of slashes."""
    t = normalize_path(path)
    cut = F.regexp_replace(t, "/+$", "")
    last = F.regexp_extract(cut, "([^/]*)$", 1)
    return F.when(last != "", last).otherwise(t)


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(text(path), r"[\\/]+", "/")


def process_name(attr: Column | str) -> Column:
    return basename(F.split(text(attr), " ")[0])


def process_exe(attr: Column | str) -> Column:
    """First word if it holds a slash, else null."""
    first = F.split(text(attr), " ")[0]
    return F.when(first.rlike(r"[\\/]"), first)


def process_cmdline(attr: Column | str) -> Column:
    """Whole text if it has a blank, else null."""
    t = text(attr)
    return F.when(t.contains(" "), t)


def object_key(attr: Column, uuid: Column) -> Column:
    return F.coalesce(blank_to_null(attr), text(uuid))


def object_name(key: Column | str) -> Column:
    t = text(key)
    return F.when(t == "", F.lit(None)).when(t.contains("->"), t).otherwise(basename(t))


# B9
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
FLOW = rf"({_IP})(?::(\d{{1,5}}))?->({_IP})(?::(\d{{1,5}}))?"
ENDPOINT = rf"({_IP})(?::(\d{{1,5}}))?"


def flow_endpoints(key: Column | str) -> Column:
    """struct(local_ip, local_port, remote_ip, remote_port) of `ip[:port]->ip[:port]`, else the remote side alone."""
    t = text(key)

    def part(pattern: str, i: int) -> Column:
        got = F.regexp_extract(t, pattern, i)
        return F.when(got != "", got)

    two = t.rlike(FLOW)
    return F.struct(
        F.when(two, part(FLOW, 1)).alias("local_ip"), F.when(two, part(FLOW, 2)).cast("int").alias("local_port"),
        F.when(two, part(FLOW, 3)).otherwise(part(ENDPOINT, 1)).alias("remote_ip"),
        F.when(two, part(FLOW, 4)).otherwise(part(ENDPOINT, 2)).cast("int").alias("remote_port"))


# B10
def event_result(raw_json: Column | str) -> Column:
    """First non-blank outcome field of a raw record, else null."""
    c = F.col(raw_json) if isinstance(raw_json, str) else raw_json
    return F.coalesce(*[blank_to_null(F.get_json_object(c, f"$.{k}")) for k in
                        ("result", "returnValue", "return_value", "status", "statusCode", "errno", "error")])


# B11
def syscall_direction(event: Column, kind: Column) -> Column:
    e, k = F.upper(text(event)), F.lower(text(kind))
    return cases([(e.isin("FORK", "CLONE", "EXIT"), "P_TO_P"), ((e == "ACCEPT") & k.isin(S.NETWORK_TYPES), "O_TO_P"),
                  (k == "process", "P_TO_P"), (k != "", "P_TO_O")], F.lit("UNKNOWN"))


def semantic_flow_direction(event: Column, kind: Column) -> Column:
    e, k = F.upper(text(event)), F.lower(text(kind))
    return cases([(e.isin("READ", *S.EXECUTIONS), "O_TO_P"), (e.isin(*S.MUTATIONS, "CONNECT", "SEND"), "P_TO_O"), (e.isin("RECV", "ACCEPT"), "O_TO_P"),
                  (e.isin("FORK", "CLONE") | (k == "process"), "P_TO_P"), (e == "EXIT", "NONE")], F.lit("UNKNOWN"))


# B12
def ip_number(ip: Column | str) -> Column:
    """IPv4 as a number; null for anything else."""

    def number(t: Column) -> Column:
        parts = F.split(t, r"\.")
        value = sum((parts[i].cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint"))
        return F.when(t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"), value)

    return let(text(ip), number)


def _inside(n: Column) -> Column:
    tests = []
    for net in S.INTERNAL_NETWORKS:
        base, bits = net.split("/")
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        tests.append(n.between(low, low + (1 << 32 - int(bits)) - 1))
    return any_of(tests)


def is_internal_ip(ip: Column | str) -> Column:
    return let(ip_number(ip), lambda n: F.coalesce(_inside(n), F.lit(False)))


def is_external_ip(ip: Column | str) -> Column:
    """Both tests are false for what is no IPv4 address."""
    return let(ip_number(ip), lambda n: F.coalesce(n.isNotNull() & ~_inside(n), F.lit(False)))


# B13
def has_download_hint(cmdline: Column | str) -> Column:
    """Markers count anywhere and in lower case, so a plain -o does."""
    return contains_any(F.lower(text(cmdline)), ["http://", "https://", "ftp://", "-o"])


# B15 - B18
def classify_process_type(name: Column, exe: Column) -> Column:
    n = F.lower(F.coalesce(blank_to_null(name), basename(exe)))
    return cases([(n == "", "unknown_binary"), *[(n.isin(v), k) for k, v in S.PROCESS_TYPES.items()],
                  (text(exe).rlike(r"[\\/]"), "binary")], F.lit("unknown_binary"))


def glob_pattern(glob: str) -> str:
    """Case-sensitive, anchored regular expression of a file-name pattern with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if c in r"\.^$+{}[]|()" else c) for c in glob) + "$"


def _path_pattern(value: str) -> str:
    """Literal path text as a regular expression in which any run of slashes of either kind counts as one."""
    return "".join(r"[\\\\/]+" if c == "/" else "\\" + c if c in r"\.^$+{}[]|()*?" else c for c in value)


def _class_pattern(how: str, values: list[str]) -> str:
    """One regular expression for all values of an object class."""
    if how == "glob":
        out = []
        for v in values:
            if "*" in v or "?" in v:
                body = glob_pattern(v)[1:-1].replace("/", r"[\\/]+")
                out += [f"^{body}$", rf"(?:^|[\\/]){body}[\\/]*$"] if "/" not in v else [f"^{body}$"]
            elif v.endswith("/"):
                out.append("^" + _path_pattern(v))
            else:
                out.append(_path_pattern(v))
        return "(?s)" + "|".join(out)
    body = "|".join(_path_pattern(v) for v in values)
    return {"prefix": f"^(?:{body})", "contains": f"(?:{body})", "suffix": f"(?i)(?:{body})$"}[how]


def matches_business_file(path: Column | str) -> Column:
    """Globs match the whole path or its last part, entries that end in a slash are prefixes, others match anywhere."""
    return text(path).rlike(_class_pattern("glob", S.BUSINESS_PATHS))


def classify_object(kind: Column | str, key: Column | str) -> Column:
    k, p = F.lower(text(kind)), text(key)
    ends = let(flow_endpoints(key), lambda f: F.struct(ip_number(f["remote_ip"]).alias("r"), ip_number(f["local_ip"]).alias("l")))

    def network(e: Column) -> Column:
        out = [(n.isNotNull() & ~_inside(n), "external_ip") for n in (e["r"], e["l"])] + [(n.isNotNull(), "internal_ip") for n in (e["r"], e["l"])]
        return cases([*out, (starts_any(p, ["unix:", "localhost", "127."]), "local_ipc"), (p.contains("->"), "external_ip")], F.lit("network"))

    files = [(p.rlike(_class_pattern(how, values)), name) for name, how, values in S.FILE_CLASSES]
    return cases([((p == "") & (k != ""), k), (k.isin(S.NETWORK_TYPES), let(ends, network)), (k.isin("pipe", "ipc"), "local_ipc"), (k == "process", "process"), *files,
                  ((p != "") & (k.isin("file", "registry") | p.rlike(r"^[\\/]")), "file")], F.when(k != "", k).otherwise(F.lit("object")))


def contains_upload_marker(path: Column | str) -> Column:
    return contains_any(F.lower(normalize_path(path)), S.UPLOAD_MARKERS)


def under_web_root(path: Column | str) -> Column:
    return starts_any(F.lower(normalize_path(path)), S.WEB_ROOTS)


# B19, B20
# Fixed values.
TEMP_EXEC_MARKERS = ["/tmp/", "/var/tmp/", "/dev/shm/", "ztmp"]
SERVICE_PREFIXES, SERVICE_EXCEPTIONS = ["/etc/", "/usr/", "/usr/local/libexec/", "/var/run/", "/var/spool/postfix/", "/dev/"], ["/dev/shm/"]
PLACEHOLDERS = ["file_object_block"]


def is_temp_exec_path(key: Column | str) -> Column:
    return contains_any(F.lower(text(key)), TEMP_EXEC_MARKERS)


def is_system_service_key(key: Column | str) -> Column:
    t = F.lower(text(key))
    return (t != "") & ~is_temp_exec_path(key) & ~starts_any(t, SERVICE_EXCEPTIONS) & starts_any(t, SERVICE_PREFIXES)


def is_placeholder_key(key: Column | str) -> Column:
    return F.lower(text(key)).isin(PLACEHOLDERS)


def extract_cmd_path(cmdline: Column | str) -> Column:
    """First word in lower case if it is a path from / or ./, else empty; quotes around it do not count."""
    bare = F.regexp_replace(text(cmdline), "^['\"]+|['\"]+$", "")
    first = F.regexp_replace(F.regexp_extract(bare, r"^\s*(\S+)", 1), "^['\"]+|['\"]+$", "")
    return F.when(first.startswith("/") | first.startswith("./"), F.lower(first)).otherwise(F.lit(""))


# B21, B22
def port_class(port: Column | str) -> Column:
    p = (F.col(port) if isinstance(port, str) else port).cast("int")
    return F.when(p < 1024, 0).when(p < 49152, 1).when(p.isNotNull(), 2)


def address_distance(a: Column, b: Column) -> Column:
    """4 if equal, 5 without an address, 6 for netlink, 7 for what is no dotted address, else the place of the last octet that differs."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    octets = [(F.get(x, F.lit(i)).isNotNull() & ~F.get(x, F.lit(i)).eqNullSafe(F.get(y, F.lit(i))), i + 1) for i in (3, 2, 1, 0)]
    return cases([(a == b, 4), ((a == "NA") | (b == "NA"), 5), ((a == "NETLINK") | (b == "NETLINK"), 6), (~a.contains(".") | ~b.contains("."), 7), *octets], F.lit(0))


# B24
def file_extension(path: Column | str) -> Column:
    """Extension as the file-type table knows it: after the first dot, `so` for anything with so, after the last dot of several; empty for none or python files."""
    last = F.regexp_extract(text(path), "([^/]*)$", 1)
    first = F.regexp_extract(last, r"^[^.]*\.(.*)$", 1)
    return F.when(last.contains("python") | ~last.contains("."), F.lit("")).when(first.contains("so"), F.lit("so")).when(
        first.contains("."), F.regexp_extract(last, r"([^.]*)$", 1)).otherwise(first)


# B25
def banded(c: Column, bands, default: str) -> Column:
    return cases([(c >= low, name) for low, name in bands], F.lit(default))


def severity(percentile: Column) -> Column:
    return banded(percentile, S.SEVERITIES, "Negligible")


def risk_level(score: Column) -> Column:
    return banded(score, S.RISK_LEVELS, "info")


def time_bin(seconds: Column) -> Column:
    return cases([(seconds.isNull(), "unknown"), (seconds < 60, "<1m"), (seconds < 300, "<5m"), (seconds < 900, "<15m"), (seconds < 3600, "<60m")], F.lit(">=60m"))


# B26
ATTACK_ID = r"\bT\d{4}(?:[./]\d{3})?\b"


def canonical_attack_id(c: Column | str) -> Column:
    return F.replace(F.upper(text(c)), F.lit("/"), F.lit("."))


def canonical_tactic(c: Column | str) -> Column:
    t = F.upper(text(c))
    names = F.create_map(*[F.lit(x) for kv in S.TACTICS.items() for x in kv])
    plain = F.regexp_replace(F.regexp_replace(t, "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.element_at(names, t), plain)


def split_tactics(c: Column | str) -> Column:
    parts = F.transform(F.split(text(c), r"[;,+|]|/"), canonical_tactic)
    return F.array_distinct(F.array_remove(parts, ""))


def extract_attack_ids(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(ATTACK_ID), F.lit(0)), canonical_attack_id))


# B27
def window_status(attack_ids: Column, note: Column) -> Column:
    """struct(status, confirmed, attempted) of a ground-truth window by its techniques and its note."""
    low = F.lower(text(note))
    failed_near = F.filter(attack_ids, lambda t: F.rlike(low, F.concat(F.replace(F.lower(t), F.lit("."), F.lit(r"\.")), F.lit(r"[^;,.]{0,18}(?:attempted|failed)"))))
    tried = contains_any(low, ["attempted", "failed"])
    hinted = F.filter(attack_ids, lambda t: tried & (((t == "T1055") & low.contains("inject")) | ((t == "T1068") & contains_any(low, ["elevate", "privilege escalation"]))))
    attempted = F.array_distinct(F.concat(failed_near, hinted))
    all_tried = (F.size(attack_ids) > 0) & low.contains("attempted") & ~low.contains("confirmed") & (F.size(attempted) == 0)
    attempted = F.when(all_tried, attack_ids).otherwise(attempted)
    confirmed = F.array_except(attack_ids, attempted)
    status = cases([(F.size(confirmed) > 0, "confirmed"), (F.size(attempted) > 0, "attempted_failed")], F.lit("insufficient"))
    return F.struct(status.alias("status"), confirmed.alias("confirmed"), attempted.alias("attempted"))


# B28
CHAIN_TAGS = {
    "browser_compromise": ["firefox", "browser"], "phishing_link": ["phishing", "nasa.ng"], "phishing_attachment": ["tcexec", "xlsm"],
    "shell": ["shell", "sh ", "bash", "execfile"], "callback": ["callback", "operator console", "c2", "drakon"],
    "scan": ["scan", "portscan", "netrecon"], "cleanup": ["rm ", "file deletion"],
}


def tags(c: Column | str, table: dict[str, list[str]]) -> Column:
    """Names of the table, in its order, one of whose markers the lower-case text holds."""
    low = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.array_compact(F.array(*[F.when(contains_any(low, m), F.lit(k)) for k, m in table.items()]))


# B29
def action_allowed(action: Column | str, allowed: list[str]) -> Column:
    t = F.regexp_replace(F.lower(text(action)), "^event_", "")
    other = F.lit("other") if "other" in allowed else F.lit(None).cast("string")
    return F.when(t == "", F.lit(None)).when(t.isin(allowed), t).otherwise(other)


# B30
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "was", "were", "are", "not", "its", "into", "onto"]


def kb_tokens(c: Column | str) -> Column:
    """Sorted distinct lower-case words of three characters and more, without stopwords."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_.-]{2,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS])))


def normalize_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


# B31
def base_task_id(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?<=.)_aug\d{3}$", "")


def is_augmented_task(c: Column | str) -> Column:
    return text(c).rlike(r"_aug\d{3}$")


# B32
PATH_SEMANTICS = {
    "shell profile modification": [".bashrc", ".profile", "/etc/profile", "authorized_keys"],
    "scheduled task or service artifact": ["/etc/cron", "crontab", "systemd", "service"],
    "temporary executable artifact": ["/tmp/", "\\temp\\", "/var/tmp/"],
    "host discovery file": ["/etc/passwd", "/proc/", "/etc/shadow"],
}
COMMANDS = ["bash", "sh", "curl", "wget", "python", "python3", "perl", "nc", "ssh", "scp", "tar", "whoami", "netstat", "sudo", "powershell", "cmd.exe"]


def path_semantics(c: Column | str) -> Column:
    return tags(c, PATH_SEMANTICS)


def os_hint(c: Column | str) -> Column:
    low = F.lower(text(c))
    return cases([(low.rlike(r"\b[a-z]:\\") | contains_any(low, ["powershell", "cmd.exe", "wmic", "regsvr32"]), "windows"),
                  (contains_any(low, ["osascript", "launchd", "launch agent", "/users/"]), "macos"),
                  (contains_any(low, ["/bin/", "/etc/", "bash", "systemd", "cron"]), "linux")], F.lit("unknown"))


def action_families(actions: Column, claims: Column) -> Column:
    """Sorted families of a path from its set of raw actions and the text of its claims."""
    low = F.lower(text(claims))

    def acts(*names: str) -> Column:
        return F.arrays_overlap(actions, F.array(*[F.lit(n) for n in names]))

    burst = contains_any(low, ["network_service_discovery", "short_lived_connection_burst"])
    pairs = {
        "credential": contains_any(low, ["credential", "password", "token", "secret"]),
        "execution": acts("EXECUTE", "CREATE_OBJECT", "LOAD", "MMAP", "CLONE", "FORK") | contains_any(low, ["remote_tool_transfer", "phishing_or_user_execution"]),
        "file_persistence": acts("WRITE", "RENAME", "TRUNCATE", "MODIFY_PROCESS") | contains_any(low, ["temporary_file_write_or_delete", "persistence_artifact_modification"]),
        "network_c2": acts("CONNECT", "SENDMSG", "SENDTO", "RECVMSG", "RECVFROM") | burst,
        "recon": contains_any(low, ["discover", "discovery", "enumerat", "whoami", "netstat", "scan", "find ", "ls "]) | burst,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in pairs.items()]))


def command_lexemes(c: Column | str) -> Column:
    """Sorted distinct command names of a text: known commands and script names."""
    scripts = r"\.(exe|sh|py|pl)$"
    return F.filter(kb_tokens(c), lambda w: w.isin(COMMANDS) | w.rlike(scripts))
