import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.llm import queries
from linkloom.llm.source_kind import NameModel, classify, evidence, manifest_files, name_model

SCHEMA = "file_path string, language string, size long, lines long"
WORDS = "journal column token cursor ledger header window snapshot relation marker".split()


def kinds(spark, rows):
    return {r.file_path: r.kind for r in classify(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain(package="packages/own-app"):
    return [(f"{package}/src/{d}/{a}_{b}.{x}", lang, 3000, 90) for d in ("view", "io") for a in WORDS for b in WORDS for x, lang in (("ts", "typescript"), ("rs", "rust"))]


def test_kinds_and_their_lookalikes(spark):
    p = "packages/own-app"
    rows = plain() + [
        (f"{p}/node_modules/x/lib/column.js", "javascript", 900, 30),
        (f"{p}/vendor/zyqquiblex/column.ts", "typescript", 900, 30),
        (f"{p}\\Vendor\\bravhoum-1.4\\column.ts", None, 900, 30),
        (f"{p}/src/vendor/journal/column.ts", "typescript", 900, 30),
        (f"{p}/src/vendors/column.ts", "typescript", 900, 30),
        (f"./{p}//public/column.min.js", "javascript", 90000, 1),
        (f"{p}/site/column.js", "javascript", 90000, 2),
        (f"{p}/src/min_column.js", "javascript", 900, 30),
        (f"{p}/proto/column_pb2.py", "python", 900, 30),
        (f"{p}/src/column.g.rs", "rust", 900, 30),
        (f"{p}/dist/column.js", "javascript", 900, 30),
        (f"{p}/coverage/lcov-report/column.js", "javascript", 900, 30),
        (f"{p}/src/coverage/column.js", "javascript", 900, 30),
        (f"{p}/stats/dist/column.py", "python", 900, 30),
        (f"{p}/src/generators/column.ts", "typescript", 900, 30),
        (f"{p}/src/column_words.py", "python", 4_000_000, 90_000),
        (f"{p}/src/one_line.ts", "typescript", 480, 1),
    ]
    got = kinds(spark, rows)
    short = {k.removeprefix(p + "/"): v for k, v in got.items()}
    assert short == {
        "node_modules/x/lib/column.js": "vendored", "vendor/zyqquiblex/column.ts": "vendored", "Vendor/bravhoum-1.4/column.ts": "vendored",
        "public/column.min.js": "minified", "site/column.js": "minified", "proto/column_pb2.py": "generated", "src/column.g.rs": "generated",
        "dist/column.js": "generated", "coverage/lcov-report/column.js": "generated", "src/column_words.py": "data",
    }


def test_nulls_repeats_and_empty(spark):
    assert kinds(spark, []) == {}
    rows = [(None, "rust", 9, 9), ("packages/a/src/x.rs", None, None, None), ("packages/a/src/x.rs", "RUST", 9_000_000, None), ("packages/a/src/x.rs", "rust", 9_000_000, 5)]
    assert kinds(spark, rows) == {"packages/a/src/x.rs": "data"}
    df = spark.createDataFrame(plain(), SCHEMA).withColumns({"kind": F.lit("x"), "stem": F.lit("y"), "segs": F.lit(1)})
    assert classify(df).count() == 0


def test_model_finds_foreign_and_mangled_names_improbable(spark):
    files = spark.createDataFrame([(f"src/{w}_{v}.rs", "rust") for w in WORDS for v in WORDS], "file_path string, language string")
    model = name_model(files)
    whole, worst = model.excess("rust", pa.array(["journal", "cursorToken", "xq7fzz", "bravhoum", "chunk-ebe3ccfb", "größe", "", None]))
    assert max(whole[:2]) + 2 < min(whole[2:4])
    assert worst[4] > 2.5 and worst[0] < 1 and list(worst[5:]) == [0, 0, 0]
    assert isinstance(model, NameModel) and abs(NameModel(pd.DataFrame({"language": [], "gram": [], "n": []})).usual["rust"]) == 0


def test_no_list_decides_alone(spark):
    p = "packages/own-app"
    # a template that no list has, all large; names with a listed mark, none large; a vendor folder with own words
    rows = plain() + [(f"{p}/src/{a}_{b}_matrix.rs", "rust", 90_000, 2500) for a in WORDS[:4] for b in WORDS[:4]]
    rows += [(f"{p}/src/{a}_{b}.tab.ts", "typescript", 300, 12) for a in WORDS for b in WORDS[:4]] + [(f"{p}/src/external/{w}/column.ts", "typescript", 900, 30) for w in WORDS]
    # a mangled name needs shorter lines to be minified
    rows += [(f"{p}/src/q7zx9vkw.js", "javascript", 90_000, 150), (f"{p}/src/journal.js", "javascript", 90_000, 150)] + [(f"{p}/src/{a}_{b}.js", "javascript", 3000, 90) for a in WORDS for b in WORDS]
    got = kinds(spark, rows)
    assert got == {f"{p}/src/{a}_{b}_matrix.rs": "generated" for a in WORDS[:4] for b in WORDS[:4]} | {f"{p}/src/q7zx9vkw.js": "minified"}


def test_every_file_has_one_row_of_evidence(spark, sf):
    manifest = spark.read.parquet(f"{sf}/file_manifest.parquet")
    rows = evidence(manifest)
    assert rows.count() == rows.select("file_path").distinct().count() == manifest_files(manifest).count()


def test_given_data(spark, sf):
    files = manifest_files(spark.read.parquet(f"{sf}/file_manifest.parquet")).count()
    found = queries.p2_found(spark, sf)
    assert found.columns == ["file_path"] and 0 < found.count() < files / 2
    assert found.count() == found.distinct().count()
