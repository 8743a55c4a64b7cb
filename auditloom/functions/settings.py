"""Default settings of the analytics. All values here are fixed values of the domain; pass your own to change them."""

from __future__ import annotations

# --- event names -------------------------------------------------------------------------------------------
EVENT_TYPES = {
    "EXECUTE": "EXEC", "CREATE_OBJECT": "CREATE", "LOAD_ELF": "LOAD", "LOADLIBRARY": "LOAD", "SENDMSG": "SEND",
    "SENDTO": "SEND", "RECVMSG": "RECV", "RECVFROM": "RECV", "FORK_WITH_SHARED_OPEN_FILE": "FORK",
    "OPEN_WITH_CLOSE_ON_EXEC": "OPEN", "MODIFY_PROCESS": "CHMOD",
}
NETWORK_EVENTS = ["CONNECT", "ACCEPT", "SEND", "RECV"]
MUTATIONS = ["WRITE", "CREATE", "TRUNCATE", "CHMOD", "CHOWN", "RENAME", "DELETE"]
EXECUTIONS = ["EXEC", "LOAD", "MMAP"]
NETWORK_TYPES = ["flow", "socket", "network"]

# --- process names -----------------------------------------------------------------------------------------
PROCESS_TYPES = {
    "shell": ["sh", "bash", "zsh", "dash"],
    "interpreter": ["python", "python3", "perl", "php", "node", "ruby", "lua"],
    "downloader": ["curl", "wget", "scp", "sftp", "ftp", "python", "perl", "php", "node"],
    "network_tool": ["curl", "wget", "scp", "sftp", "ftp", "nc", "ncat", "socat", "ssh"],
    "archive_tool": ["tar", "zip", "gzip", "bzip2", "xz", "7z"],
    "web_service": ["nginx", "httpd", "apache2", "php-fpm", "php-cgi", "tomcat", "uwsgi", "gunicorn", "node"],
    "remote_service": ["sshd", "dropbear", "telnetd", "xrdp", "sftp-server"],
    "common_daemon": ["systemd", "cron", "crond", "sshd", "nginx", "apache2", "httpd", "mysqld", "redis-server", "rsyslogd", "dbus-daemon"],
}

# --- networks ----------------------------------------------------------------------------------------------
INTERNAL_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"]
WEB_C2_PORTS = [80, 443, 8080, 8443]
LATERAL_PORTS = [22, 445, 3389, 3306, 5432, 6379, 9200, 27017]

# --- paths -------------------------------------------------------------------------------------------------
WEB_ROOTS = ["/var/www/", "/usr/share/nginx/html/", "/srv/www/", "/opt/tomcat/webapps/", "/www/"]
UPLOAD_MARKERS = ["upload", "uploads", "wwwroot", "webapps", "htdocs"]
BUSINESS_PATHS = ["/data/business/", "/opt/app/data/", "/srv/data/", "/home/*/Documents/", "*.sql", "*.db", "*.sqlite", "*.xlsx", "*.docx", "*.csv"]
#: Object classes of files in the order in which they are tried: (class, how, values).
FILE_CLASSES = [
    ("proc_status", "prefix", ["/proc/"]),
    ("temp_file", "prefix", ["/tmp/", "/var/tmp/", "/dev/shm/"]),
    ("credential_file", "contains", ["/etc/passwd", "/etc/shadow", ".ssh/id_rsa", ".aws/credentials", ".kube/config"]),
    ("history_file", "contains", [".bash_history", ".zsh_history", ".mysql_history", ".python_history"]),
    ("persistence_file", "prefix", ["/etc/crontab", "/etc/cron.d", "/var/spool/cron", "/etc/systemd/system", "/lib/systemd/system", "/etc/rc.local"]),
    ("privilege_file", "prefix", ["/etc/sudoers", "/etc/sudoers.d"]),
    ("auth_config_file", "prefix", ["/etc/ssh/", "/etc/pam.d/", "/etc/security/", "/etc/login.defs", "/root/.ssh/"]),
    ("log_file", "prefix", ["/var/log"]),
    ("archive_file", "suffix", [".zip", ".tar", ".gz", ".tgz", ".7z", ".rar"]),
    ("business_file", "glob", BUSINESS_PATHS),
    ("system_library", "prefix", ["/usr/lib", "/lib", "/lib64"]),
    ("system_resource", "prefix", ["/usr/share", "/usr/include", "/usr/share/locale"]),
    ("local_ipc", "prefix", ["127.0.0.1", "localhost", "unix:"]),
]
SENSITIVE_CLASSES = ["temp_file", "credential_file", "history_file", "business_file", "persistence_file", "privilege_file"]

# --- compaction and bridges --------------------------------------------------------------------------------
FORCE_KEEP_EVENTS = ["EXEC", "FORK", "CLONE", "CONNECT", "ACCEPT", "SEND", "RECV", "EXIT", "CHMOD", "CHOWN", "RENAME", "DELETE"]
FORCE_KEEP_CLASSES = [*SENSITIVE_CLASSES, "external_ip"]
SKIP_TTL_SECONDS = 600
BRIDGE_WRITES = ["WRITE", "CREATE", "RENAME"]
BRIDGE_READS = ["READ", "EXEC", "MMAP", "LOAD"]
BRIDGE_GAP_SECONDS = 1800
BRIDGES_PER_OBJECT = 20
DENIED_BRIDGE_CLASSES = ["system_library", "system_resource", "proc_status"]

# --- labels ------------------------------------------------------------------------------------------------
STATUS_DEPTHS = {"P_HIGH_VALUE_CTX": 1, "P_NET_CTX": 2, "P_WEB_CTX": 2, "P_REMOTE_CTX": 4, "P_UNTRUSTED_CTX": 3, "P_SUSPECT_CTRL_CTX": 3}
DAEMON_CHILD_TYPES = ["shell", "interpreter", "downloader", "network_tool", "unknown_binary"]
LABEL_SCORES = {
    "P_NET_CTX": 3, "P_UNTRUSTED_CTX": 5, "P_WEB_CTX": 3, "P_REMOTE_CTX": 4, "P_HIGH_VALUE_CTX": 8, "P_SUSPECT_CTRL_CTX": 8,
    "A_CHILD_SUSPICIOUS": 5, "A_BRIDGED_BY_SUSPICIOUS_OBJECT": 8, "B_EXTERNAL_RECV": 8, "B_EXTERNAL_SEND": 20, "B_EXEC_TEMP": 20,
    "B_EXEC_DOWNLOADED": 30, "B_EXEC_UPLOADED": 24, "B_EXEC_SUSPECT_WRITTEN": 28, "B_SHELL_SPAWN": 8, "B_SCRIPT_EXEC": 8,
    "B_INTERPRETER_LAUNCH": 6, "B_READ_CRED": 15, "B_READ_HISTORY": 12, "B_READ_BUSINESS": 18, "B_MASS_FILE_ACCESS": 10,
    "B_WRITE_PERSISTENCE": 30, "B_WRITE_PRIV_CONFIG": 30, "B_ARCHIVE_DATA": 18, "B_DELETE_LOG": 25, "B_LATERAL_CONNECT": 20,
    "B_REMOTE_LOGIN_SERVICE": 5, "B_WEB_WRITE": 4,
}

# --- path search and levels --------------------------------------------------------------------------------
PATH_DEPTH, PATH_SPAN_SECONDS, PATH_GAP_SECONDS = 6, 180 * 60, 120 * 60
RISK_LEVELS = [(80.0, "high"), (50.0, "medium"), (30.0, "low")]
SEVERITIES = [(99.0, "Critical"), (97.0, "Significant"), (95.0, "Moderate"), (90.0, "Minor")]
TACTICS = {
    "TA0001": "INITIAL_ACCESS", "TA0002": "EXECUTION", "TA0003": "PERSISTENCE", "TA0004": "PRIVILEGE_ESCALATION",
    "TA0005": "DEFENSE_EVASION", "TA0006": "CREDENTIAL_ACCESS", "TA0007": "DISCOVERY", "TA0008": "LATERAL_MOVEMENT",
    "TA0009": "COLLECTION", "TA0010": "EXFILTRATION", "TA0011": "COMMAND_AND_CONTROL", "TA0040": "IMPACT",
    "TA0042": "RESOURCE_DEVELOPMENT", "TA0043": "RECONNAISSANCE",
}
