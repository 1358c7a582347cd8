import pytest
from pyspark.sql import functions as F

from linkloom.llm import queries
from linkloom.llm.documentation import comment_text, is_trivial, pairs

NODE = "id string, type string, name string, file_path string, start_line long, end_line long, metadata string"
FILE = "file_path string, language string, text string"

RUST = """// a heading of the file

/// Splits the ledger into parts of equal length.
#[inline]
pub fn split_ledger(a: &str) -> u32 {
    // inner
    let x = "/* no comment */";
}

/// Far away.

fn lonely() { }
impl X {
    /**
     * Keeps the older of two.
     */
    #[must_use]
    fn keep(&self) {}
}
"""
PYTHON = 'class A:\r\n    @cached\r\n    def one(self, a="#x",\r\n            b=1):\r\n        """Counts every page\r\n        twice."""\r\n        return 1\r\n\r\n    # Returns nothing useful on Mondays.\r\n    def two(self): pass\r\n\r\n    def three(self):\r\n        x = """not documentation"""'


def found(spark, nodes, files=(("a.rs", "rust", RUST), ("a.py", "python", PYTHON))):
    df = spark.createDataFrame([(i, "FUNCTION", n, f, s, e, m) for i, n, f, s, e, m in nodes], NODE)
    return {r.node_id: (r.doc, r.code) for r in pairs(df, spark.createDataFrame(list(files), FILE)).collect()}


def test_comments_and_docstrings_are_attached(spark):
    got = found(spark, [
        ("split", "split_ledger", "a.rs", 5, 8, "{}"), ("split2", "split_ledger", "a.rs", 3, 8, None), ("lonely", "lonely", "a.rs", 12, 12, '{"doc":" "}'),
        ("keep", "keep", "a.rs", 18, 18, '{"doc":"'), ("one", "one", "a.py", 2, 7, "{}"), ("one2", "one", "a.py", 3, 7, "{}"), ("two", "two", "a.py", 10, 10, "{}"), ("three", "three", "a.py", 12, 13, "{}"),
    ])
    assert {k: v[0] for k, v in got.items()} == {
        "split": "Splits the ledger into parts of equal length.", "split2": "Splits the ledger into parts of equal length.", "keep": "Keeps the older of two.",
        "one": "Counts every page\n        twice.", "one2": "Counts every page\n        twice.", "two": "Returns nothing useful on Mondays.",
    }
    assert got["split"][1].startswith("pub fn split_ledger") and got["split"][1].endswith("}")


def test_code_must_be_there(spark):
    doc = '{"doc":"Says something useful."}'
    nodes = [("ok", "f", "a.rs", 1, 19, doc), ("late", "f", "a.rs", 1, 20, doc), ("back", "f", "a.rs", 3, 2, doc), ("zero", "f", "a.rs", 0, 2, doc), ("null", "f", "a.rs", None, 2, doc), ("gone", "f", "b.rs", 1, 1, doc), ("untold", "f", "c.rs", 1, 1, doc), (None, "f", "a.rs", 1, 1, doc)]
    files = [("a.rs", "rust", RUST), ("a.rs", "rust", RUST), ("c.rs", "rust", None), (None, None, "x")]
    assert set(found(spark, nodes + nodes[:1], files)) == {"ok"}
    assert found(spark, []) == {} and found(spark, nodes, [("z", "z", "")]) == {}


TRIVIAL = ["TODO", "tbd.", "See above.", "{@inheritDoc}", "@param id\n@returns", ":param id:\n:return:", "Args:\n    id:\nReturns:", "noqa: E501", "rustfmt::skip", "clippy::all", "return cache[key];",
           "if (x) { foldToken(x); }", "let old = fold(x, y);", "* * *", ">>>", "…", "Folds the token.", "fold_token()", "This function folds token.", "Method to fold the token.", "#region helpers", "(no documentation)",
           "Auto-generated method stub", "type: ignore", "istanbul ignore next", "# Arguments\n# Returns", "", " \u00a0 ", None, "token fold method", "Fixme: add description"]
TELLING = ["Panics on an empty token.", "Not thread-safe; hold the token lease first.", "古い定義は次の版で削除されます。", "@param key the channel to look at", "Folds the token and keeps the rest.", "Panics on an empty page.\nTODO: also handle late ones.", "Нельзя менять снимок.",
           "Returns the page that covers the quota, or nothing when the cache is late.", "See the ledger for what happens to tokens that were already folded twice."]


@pytest.mark.parametrize(("docs", "trivial"), [(TRIVIAL, True), (TELLING, False)])
def test_what_is_trivial(spark, docs, trivial):
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = df.select("doc", is_trivial(F.col("doc"), F.lit("foldToken")).alias("t")).collect()
    assert [r.doc for r in got if r.t != trivial] == []


def test_other_forms_of_a_word_say_nothing_new(spark):
    df = spark.createDataFrame([("Tallys the split.",), ("Splitting of tallies.",), ("This function tallied splits.",), ("Tallys what was split twice.",)], "doc string")
    assert [r.t for r in df.select(is_trivial(F.col("doc"), F.lit("tallySplit")).alias("t")).collect()] == [True, True, True, False]


def test_long_files_and_clashing_columns(spark):
    text = "// x\n" * 3000 + "/* " + "y" * 100_000 + " */\nfn f() { let s = \"" + "\\\"" * 3000 + "\"; }\n"
    df = spark.createDataFrame([("n", "METHOD", "f", "a.rs", 3002, 3002, None)], NODE).withColumns({"text": F.lit(1), "line": F.lit(1), "code": F.lit("c")})
    files = spark.createDataFrame([("a.rs", "rust", text)], FILE).withColumns({"n_lines": F.lit(0), "doc": F.lit("d")})
    assert [len(r.doc) for r in pairs(df, files).collect()] == [100_000]


def test_comment_marks(spark):
    df = spark.createDataFrame([("/** A.\n * B\n */",), ("/// A.\r\n    /// B",), ('"""A."""',), ("# A\n    # B",)], "c string")
    assert [r[0].split() for r in df.select(comment_text(F.col("c"))).collect()] == [["A.", "B"], ["A.", "B"], ["A."], ["A", "B"]]


def test_given_data(spark, sf):
    rows = queries.p5_found(spark, sf)
    assert rows.columns == ["node_id"] and rows.count() == rows.distinct().count() > 0


def test_nothing_is_too_long_for_the_lexer(spark):
    remark = "\n".join(f"// Explains step {i} of the merge." for i in range(900))
    hard = 'let a = "' + r"\"(((" * 600 + '";'
    text = f"{remark}\nfn merge() {{\n  {hard}\n}}\n/// Keeps the younger of two pages.\nfn keep() {{}}\nlet b = 1; // ends the line above\n// Drops every third page.\nfn drop() {{}}\n"
    js = "const a = `" + "\\`{" * 900 + "`;\n// Folds all pages of a book.\nfunction fold(p) {\n  return p;\n}\n"
    nodes = [("merge", "merge", "a.rs", 901, 903, None), ("keep", "keep", "a.rs", 905, 905, None), ("drop", "drop", "a.rs", 908, 908, None), ("fold", "fold", "b.js", 3, 5, None)]
    got = found(spark, nodes, (("a.rs", "rust", text), ("b.js", "javascript", js)))
    assert len(got["merge"][0].split("\n")) == 900
    assert {k: v[0] for k, v in got.items() if k != "merge"} == {"keep": "Keeps the younger of two pages.", "drop": "Drops every third page.", "fold": "Folds all pages of a book."}


def test_a_function_ends_where_its_block_does(spark):
    text = "/// Counts the pages of a book.\nfn count(a: u32,\n    b: u32) -> u32 {\n  if a > b { return a; }\n  let s = \"}\"; // }\n  match a { _ => {} }\n}\nfn other() {}\n"
    got = found(spark, [("count", "count", "a.rs", 2, 3, None)], (("a.rs", "rust", text),))
    assert got["count"][1] == "\n".join(text.split("\n")[1:7])


def test_escapes_come_back_as_they_were(spark):
    text = '// Reads "\\\\" and \\" as one sign, \\n as two.\nfn read() {}\n'
    assert found(spark, [("read", "read", "a.rs", 2, 2, None)], (("a.rs", "rust", text),))["read"][0] == 'Reads "\\\\" and \\" as one sign, \\n as two.'
