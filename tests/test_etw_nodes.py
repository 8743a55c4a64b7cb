"""Nodes of Windows trace records: both ends, the ids of the events, and records that lack one end."""

from auditloom.sources import logs as A


def test_nodes_of_windows_records(spark):
    lines = ['{"EventName":"Process/Start","PID":"4","PName":"svc","ChildPID":"9","ImageName":"cmd.exe"}', 'x {"EventName":"FileIO/Read","PID":"4","FileName":"C:\\\\a"} y', '{"EventName":"TcpIp/Recv","PID":"5","saddr":"1.1.1.1","sport":80,"daddr":"2.2.2.2","dport":9}',
             '{"EventName":"FileIO/Read","PID":"6"}', '{"EventName":"TcpIp/Send","PID":"7"}', '{"EventName":"Other","PID":"8"}', '{"EventName":"FileIO/Read","FileName":"f"}', "bad", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = sorted(map(tuple, A.etw_nodes(df).collect()))
    assert got == sorted([("proc::4", "process", "svc"), ("proc::9", "process", "cmd.exe"), ("proc::4", "process", "4"), ("file::C:\\a", "file", "C:\\a"), ("proc::5", "process", "5"),
                          ("flow::RECV::1.1.1.1:80->2.2.2.2:9", "flow", "1.1.1.1:80->2.2.2.2:9"), ("proc::6", "process", "6"), ("proc::7", "process", "7")])
    events = A.etw_events(df.limit(3)).collect()
    assert {x for r in events for x in (r.subject, r.object)} <= {x[0] for x in got}
