import random

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import answers, graph
from linkloom.operators.trace import trace

LINK = "source string, target string, kind string, n bigint, lines array<bigint>"


def test_innermost_interval_against_a_sweep(spark):
    rng = random.Random(3)
    spans = [("f", a := rng.randrange(400), a + rng.randrange(-5, 150), f"s{i}") for i in range(60)]
    points = [("f", p) for p in range(0, 560, 3)] + [("g", 1)]
    got = graph.innermost_enclosing(spark.createDataFrame(points, "file string, line long"), spark.createDataFrame(spans, "file string, start long, end long, id string"), "file", "line", [])
    want = {}
    for f, p in points:
        inside = [s for s in spans if s[0] == f and s[1] <= p <= s[2]]
        want[f, p] = max(inside, key=lambda s: (s[1], -s[2], s[3]))[3] if inside else None
    assert {(r.file, r.line): r.enclosing for r in got.collect()} == want


def test_trace_numbers_like_a_queue(spark):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(150)})
    rows = [(s, t, rng.choice(["CALLS", "USES", "REFERENCES", "DEPENDS_ON"]), rng.randrange(1, 4), []) for s, t in edges]
    got = [(r.n, r.from_n, r.depth, r.id) for r in trace(spark.createDataFrame(rows, LINK), "n1", "dependents", depth=3).orderBy("n").collect()]
    rank = {"CALLS": 0, "IMPLEMENTS": 1, "REFERENCES": 2, "USES": 3}
    seen, frontier, want = {"n1"}, [("n1", 0)], []
    for depth in (1, 2, 3):
        nxt = []
        for node, at in frontier:
            for s, t, k, n, _ in sorted((r for r in rows if r[1] == node and r[2] in rank), key=lambda r: (rank[r[2]], -r[3], r[0])):
                if s not in seen:
                    seen.add(s)
                    want.append((len(want) + 1, at, depth, s))
                    nxt.append((s, len(want)))
        frontier = nxt
    assert got == want


def test_trace_cap(spark):
    rows = [(f"n{i:03}", "hub", "CALLS", 1, []) for i in range(50)] + [(f"m{i}", "n000", "CALLS", 1, []) for i in range(9)]
    got = trace(spark.createDataFrame(rows, LINK), "hub", depth=2, visits=20).collect()
    assert sorted(r.n for r in got) == list(range(1, 21)) and {r.depth for r in got} == {1} and not any(r.complete for r in got)
    for cap, complete in ((58, False), (59, True), (60, True)):
        got = trace(spark.createDataFrame(rows, LINK), "hub", depth=2, visits=cap).collect()
        assert len(got) == min(cap, 59) and {r.complete for r in got} == {complete}


def test_topmost_roots(spark):
    dirs = ["a", "a/b", "a-b", "c/d/e", "c/d", "x/y", None]
    got = graph.topmost(spark.createDataFrame([(d,) for d in dirs], "dir string"))
    assert {r.dir for r in got.collect()} == {"a", "a-b", "c/d", "x/y"}
    assert [r.dir for r in graph.topmost(spark.createDataFrame([("",), ("a",)], "dir string")).collect()] == [""]


def test_text_functions(spark):
    df = spark.createDataFrame([("ÜBER Ab",)], "s string")
    row = df.select(T.ascii_lower(F.col("s")).alias("a"), T.clip(F.col("s"), 3).alias("b"), T.squash(F.lit(" x \n y ")).alias("c"), T.dir_of(F.lit("top.py")).alias("d"), T.first_fenced_block(F.lit("a\n```ts\nx\ny\n```")).alias("e"), T.printable_line(F.lit("a\x01\tb\r")).alias("f"), T.language_of(F.lit("A.PYI")).alias("g")).first()
    assert tuple(row) == ("Über ab", "ÜBE…", "x y", ".", "x\ny\n", "a�\tb", "python")
    bad = ["/a", "C:x", "a/../b", "", None, "..", "a/..b", "./a//b"]
    got = spark.createDataFrame([(p,) for p in bad], "p string").select(T.refused_path(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, True, True, False, False]


def test_pages_join_up_and_never_stall(spark):
    rows = spark.createDataFrame([("g", i, 30) for i in range(10)] + [("h", 0, 999)], "g string, i long, size long")
    page = answers.page_that_fits(rows, "g", [F.col("i")], F.col("size"), 100).collect()
    assert sorted((r.g, r.i, r.next) for r in page) == [("g", 0, 3), ("g", 1, 3), ("g", 2, 3), ("h", 0, None)]


def test_drift_and_empty(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, d string")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "1")], "k string, d string")
    assert sorted(tuple(r) for r in answers.drift(a, b, "k", "d").collect()) == [("w", "new"), ("x", "missing"), ("y", "changed")]
    assert answers.drift(a.limit(0), b.limit(0), "k", "d").count() == 0
