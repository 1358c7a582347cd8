import json
import random

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import answers, graph, ranks
from linkloom.operators.ranks import numbered_within
from linkloom.plans.build import owned_documents
from linkloom.sources.files import IGNORED


def test_numbers_go_on_over_partitions_of_a_hot_key(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(10**6), i) for i in range(3000)] + [(rng.choice(["a", "b", None]), i, i) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    parts, kept = [], ranks.cut
    monkeypatch.setattr(ranks, "cut", lambda df: parts.append(kept(df)) or parts[-1])
    got = numbered_within(spark.createDataFrame(rows, "k string, v long, i long"), ["k"], [F.desc("v"), F.asc("i")]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert {(r.k, r.at, r.i, r.of) for r in got} == {(k, n, i, len(own)) for k, own in want.items() for n, i in enumerate(own, 1)}
    hot = [r["count"] for r in parts[0].filter("k = 'hot'").groupBy("_part").count().collect()]
    assert len(hot) > 2 and max(hot) < 1500
    assert numbered_within(spark.createDataFrame([], "k string, v long"), ["k"], [F.asc("v")]).count() == 0


def test_spans_with_absurd_ends_take_few_buckets(spark):
    spans = [("f", 1, 10**15, "all"), ("f", 10, 20, "small"), ("f", 70, 5000, "wide"), ("f", 64, 64 * 16**4 * 17, "huge"), ("f", 100, 50, "back")]
    df = spark.createDataFrame(spans, "file string, start long, end long, id string")
    buckets = df.filter("start <= end").select("id", graph.span_buckets(F.col("start"), F.col("end")).alias("b")).groupBy("id").count().collect()
    assert max(r["count"] for r in buckets) <= graph.BUCKET_STEP + 1
    points = spark.createDataFrame([("f", p) for p in (0, 5, 15, 71, 4999, 6000, 10**9)], "file string, line long")
    got = {r.line: r.enclosing for r in graph.innermost_enclosing(points, df, "file", "line", []).collect()}
    assert got == {0: None, 5: "all", 15: "small", 71: "wide", 4999: "wide", 6000: "huge", 10**9: "all"}


def test_pages_hold_what_fits(spark):
    rng = random.Random(2)
    sizes = {g: [rng.randrange(1, 130) for _ in range(40)] for g in "ab"}
    df = spark.createDataFrame([(g, i, z) for g, own in sizes.items() for i, z in enumerate(own)], "g string, i long, z long")
    want = {}
    for g, own in sizes.items():
        page, used = 1, 0
        for i, z in enumerate(own):
            if used and used + z > 100:
                page, used = page + 1, 0
            used += z
            want[g, i] = page
    assert {(r.g, r.i): r.page for r in answers.pages(df, "g", [F.col("i")], F.col("z"), 100).collect()} == want


def test_tables_share_a_budget(spark):
    rng, names, budget = random.Random(3), ["x", "y", "z"], 100
    groups = {f"g{k}": {t: [rng.randrange(1, 60) for _ in range(rng.randrange(7))] for t in names} for k in range(25)}
    rows = [(g, t, n, len(own), z) for g, tables in groups.items() for t, own in tables.items() for n, z in enumerate(own, 1)]
    want = {}
    for g, tables in groups.items():
        if not any(tables.values()):
            continue
        pool, shown = budget, []
        for i, t in enumerate(names):
            share, used, n = pool // (len(names) - i), 0, 0
            while n < len(tables[t]) and used + tables[t][n] <= share:
                used, n = used + tables[t][n], n + 1
            pool -= used
            shown.append(n)
        for i, t in enumerate(names):
            while shown[i] < len(tables[t]) and tables[t][shown[i]] <= pool:
                pool -= tables[t][shown[i]]
                shown[i] += 1
        want |= {(g, t): (shown[i], len(tables[t])) for i, t in enumerate(names)}
    df = spark.createDataFrame(rows, "g string, table string, at long, of long, size long")
    assert {(r.g, r.table): (r.shown, r.total) for r in answers.fitted_tables(df, "g", names, budget).collect()} == want


def test_cells_are_clipped_by_their_json_bytes(spark):
    texts = ["", "plain", 'a"b\\c\n\t\r', "\x01\x1f", "ö" * 40, "日本" * 30, "x" * 500, '"' * 300, "𝓐𠀀" * 20, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.json_bytes(F.col("t")).alias("n"), T.clip_json(F.col("t"), 40).alias("c"))
    for r in df.collect():
        if r.t is None:
            assert r.n is None and r.c in (None, "…")
            continue
        size = lambda x: len(json.dumps(x, ensure_ascii=False).encode())
        assert r.n == size(r.t)
        best = next(k for k in range(len(r.t), -1, -1) if size(r.t[:k]) + 3 <= 40)
        assert r.c == (r.t if size(r.t) <= 40 else r.t[:best] + "…")


def test_percent_signs_and_logs(spark):
    paths = ["/a%20b", "100%", "%zz%41+", "%C3%A9", "plain", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(T.percent_decoded(F.col("p"))).collect()
    assert [r[0] for r in got] == ["/a b", "100%", "%zzA+", "é", "plain", None]
    logs = ["start\n  Error: no file\n   6: std::rt::start\nat x (a.ts:1:2)\nfatal: stop\nINVALID input\n", "one\r\ntwo\n\nthree\nfour\n", "6: 7 lines read\n", "", "at home\nStack backtrace:\n"]
    got = spark.createDataFrame([(x,) for x in logs], "x string").select(T.failure_summary(F.col("x"))).collect()
    assert [r[0] for r in got] == ["fatal: stop | INVALID input", "two | three | four", "6: 7 lines read", "", ""]
    assert len(spark.createDataFrame([("error " + "x" * 900,)], "x string").select(T.failure_summary(F.col("x"))).first()[0]) == 401


def test_hints_freshness_and_ownership(spark):
    nodes = spark.createDataFrame([(f"npm:a:src/fold_{i}().", "fold") for i in range(7)] + [("x:y:z#", "z")], "id string, name string")
    lost = spark.createDataFrame([("npm:b:lib/fold().",), ("npm:b:nothing#",), ("()",)], "id string")
    hints = answers.node_hints(lost, nodes).collect()
    assert sorted((r.id, r.hint) for r in hints) == [("npm:b:lib/fold().", f"npm:a:src/fold_{i}().") for i in range(5)]
    files = spark.createDataFrame([("a/x.ts", "1"), ("b/x.tsx", "2"), ("c/y.ts", None)], "file_path string, content_hash string")
    assert [r.file_path for r in answers.path_hints(files, "q/x.ts").collect()] == ["a/x.ts", "b/x.tsx"]
    now = spark.createDataFrame([("a/x.ts", "1"), ("c/y.ts", "9"), ("new.ts", "1")], "file_path string, content_hash string")
    answer = spark.createDataFrame([("a/x.ts",), ("b/x.tsx",), ("c/y.ts",), ("c/y.ts",), ("new.ts",), (None,)], "file_path string")
    assert sorted(tuple(r) for r in answers.freshness(answer, files, now).collect()) == [("b/x.tsx", "missing"), ("c/y.ts", "changed")]
    docs = spark.createDataFrame([("a/x.ts",), ("a/gone.ts",), ("a/b.zig",), ("dist/b.zig",), (".hid/b.zig",)], "path string")
    owned = owned_documents(docs, spark.createDataFrame([("a/x.ts",)], "path string"), IGNORED).collect()
    assert {r.path: r.state for r in owned} == {"a/x.ts": "listed", "a/gone.ts": "skipped", "a/b.zig": "other", "dist/b.zig": "ignored", ".hid/b.zig": "ignored"}
