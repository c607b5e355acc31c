"""Small hand-written inputs shared by the tests."""

from spanloom.functions import name_at, tree_from_text
from spanloom.operators.blocks import Context
from spanloom.operators.formats import Formatter, FunctionTarget
from spanloom.plans import TraceConfig, prepare
from spanloom.operators.services import resolve_services
from spanloom.operators.stats import BLOCK_UPDATE, SCHEDULER_LOOP

DEEP = "root(left(leaf,twig(bud(petal(dew)))),right(bark(moss,ant),root),ground)"
HOLLOW = "((,()),(()),)"
TYPICAL = "(worker-3,1700000000123,SpanStart(span-17,Fn(shop.Cart.add(int,java.lang.String),(4, pears),ok)))"
MALFORMED = ["one(two", "one(two)three", "one(two)(three)", "one,two", "one(two))", ")("]

#: A run of our own: when each JVM came up, was ready, registered and ended, and what its tracer cost.
JVMS = {
    "coord": {"host": "10.4.0.1", "port": 6100, "service": "sparkDriver", "up": 12, "ready": 57, "registered": 60, "end": 930, "overhead": 9},
    "wk1": {"host": "10.4.0.2", "port": 6200, "service": "sparkExecutor", "up": 40, "ready": 55, "registered": 71, "end": 905, "overhead": 3},
    "wk2": {"host": "10.4.0.3", "port": 6200, "service": "sparkExecutor", "up": 44, "ready": 98, "registered": 99, "end": 911, "overhead": 21},
    "probe": {"host": "10.4.0.9", "port": 6900, "service": "healthProbe", "up": 5, "ready": 6, "registered": 7, "end": 990, "overhead": 1},
}
REMOVED = "healthProbe"
#: (time, sender, receiver, content); the receiver logs it.
MESSAGES = [
    (110, "wk1", "coord", "Register"),
    (118, "wk2", "coord", "Register"),
    (140, "coord", "wk1", "Launch(17)"),
    (141, "coord", "wk2", "Launch(18)"),
    (300, "probe", "coord", "Alive"),
    (520, "wk2", "coord", "Finished(18, ok)"),
]
#: (time, what, argument) in the scheduler of the driver.
SCHEDULER = [(112, "ExecutorAdded", "left"), (119, "ExecutorAdded", "right"), (130, "JobSubmitted", "report"), (700, "JobSubmitted", "cleanup")]
#: (stage, part) to begin and end; one never ends.
TASKS_RUN = {(4, 0): (142, 391), (4, 1): (143, 519), (5, 0): (600, 680), (5, 1): (610, None)}
#: (time, JVM, block, level).
BLOCKS_SET = [(150, "wk1", "rdd_3_0", "disk"), (151, "wk2", "rdd_3_1", "memory"), (151, "wk2", "rdd_3_2", "memory"), (640, "wk1", "rdd_3_0", "none")]
#: (id, JVM, start, end, item, amount, price).
CALLS = [("c1", "wk1", 200, 260, "pear", 3, 12), ("c2", "wk2", 210, 215, "plum", 1, 2), ("c3", "wk2", 900, None, "fig", 2, 6)]
PRICE = "shop.Till.price"


def _run():
    """Lines of the run, in the order of JVMs."""
    address = lambda jvm: f"/{JVMS[jvm]['host']}:{JVMS[jvm]['port']}"
    for uuid, jvm in JVMS.items():
        yield uuid, jvm["up"], f"SpanStart(boot-{uuid},JVMStart)"
        yield uuid, jvm["ready"], f"SpanEnd(boot-{uuid})"
        yield uuid, jvm["registered"], f"Service({jvm['service']},{address(uuid)})"
        yield uuid, jvm["end"], "MainEnd"
        yield uuid, jvm["end"] + 4, f"InstrumentOverhead({jvm['overhead']})"
    for ts, sender, receiver, content in MESSAGES:
        yield receiver, ts, f"RPC({address(sender)},{address(receiver)},{content})"
    for ts, what, argument in SCHEDULER:
        yield "coord", ts, f"Fn({SCHEDULER_LOOP},({what}({argument})),null)"
    for (stage, part), (begin, end) in TASKS_RUN.items():
        yield "coord", begin, f"Fn({SCHEDULER_LOOP},(BeginEvent(Task({stage},{part}))),null)"
        if end is not None:
            yield "coord", end, f"Fn({SCHEDULER_LOOP},(CompletionEvent(Task({stage},{part}))),null)"
    for ts, uuid, block, level in BLOCKS_SET:
        yield uuid, ts, f"Fn({BLOCK_UPDATE},({block},{level}),null)"
    for span, uuid, start, end, item, amount, price in CALLS:
        yield uuid, start, f"SpanStart({span},Fn({PRICE}(string,int),({item},{amount}),{price}))"
        if end is not None:
            yield uuid, end, f"SpanEnd({span})"


RUN = [f"({uuid},{ts},{body})" for uuid, ts, body in _run()]


def service_of(uuid):
    jvm = JVMS[uuid]
    return f"{jvm['host']} {jvm['port']} {jvm['service']}"


SHOWN = [uuid for uuid, jvm in JVMS.items() if jvm["service"] != REMOVED]

#: Two traces; "late" registers on the address that the fetcher of "hand" had before.
SERVICES = [
    [
        "(boss,100,Service(sparkDriver,/192.168.7.1:7001))",
        "(hand,130,Service(driverPropsFetcher,/192.168.7.2:7101))",
        "(hand,170,Service(sparkExecutor,/192.168.7.2:7102))",
        "(help,140,Service(driverPropsFetcher,/192.168.7.3:7201))",
        "(help,190,Service(sparkExecutor,/192.168.7.3:7202))",
        "(late,300,Service(sparkExecutor,/192.168.7.2:7101))",
    ],
    [
        "(chief,50,Service(sparkDriver,/192.168.7.1:7001))",
        "(aide,60,Service(sparkExecutor,/192.168.7.4:7301))",
    ],
]

NO_RULES = TraceConfig.from_mapping({})


def trees(spark, *texts):
    """A frame with column ``tree`` and the position ``i`` of its text."""
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "i int, text string").withColumn("tree", tree_from_text("text").column)


def evaluate(spark, text, *columns):
    """Values of column functions of one tree."""
    frame = trees(spark, text)
    row = frame.select(*[c("tree").column.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return list(row)


def prepared(spark, *traces, config=NO_RULES):
    rows = [(i, line) for i, trace in enumerate(traces) for line in trace]
    events = (
        spark.createDataFrame(rows, "trace_id int, text string")
        .withColumn("tree", tree_from_text("text").column)
        .select("trace_id", name_at("tree", "1").column.alias("uuid"), name_at("tree", "2").cast("bigint").column.alias("ts"), "tree")
    )
    return prepare(events, config)


def run_context(spark, removed=(f".*{REMOVED}",)):
    ready = prepared(spark, RUN)
    formats = {
        FunctionTarget(SCHEDULER_LOOP): "loop: $1.0 of $1.1",
        FunctionTarget(BLOCK_UPDATE): "$1 now $2",
        FunctionTarget(PRICE): "$2 x $1 = $r",
    }
    return Context(ready, resolve_services(ready, removed), Formatter.from_formats(formats))


def rows(frame):
    return [tuple(r) for r in frame.collect()]
