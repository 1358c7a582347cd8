"""Functions and methods paired with their documentation.

Source texts are lexed into rows by one pattern a language. Running sums over the tokens of a file
give line numbers, bracket depth and blank lines. Runs of comment lines, and runs without a blank line
that end in a line of code (gaps and islands), tie comments, attributes and decorators to the definition
below them; the next row of code gives the string that opens a Python body. Where braces are blocks, the
brackets of one depth follow each other in turn, so lead windows over a depth delimit each function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Escaped quotes and backslashes stand as single signs while a text is lexed, so that no token needs a
#: loop over groups, which would have a bound: the pattern engine recurses for them.
_ESCAPED = {r"\\": "\ufdd0", r"\"": "\ufdd1", r"\'": "\ufdd2", r"\`": "\ufdd3"}
_LINE = r"\r?\n[ \t]*"
_REST = r"[^\n\r\"'`/#()\[\]{}@ \t]+|[ \t]+|[\s\S]"
_DOUBLE, _SINGLE = r'"[^"\n]*+"', r"'[^'\n]*+'"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
LEXERS = {
    "python": rf'[rRbBuUfF]{{0,2}}"""[\s\S]*?(?:"""|\z)|[rRbBuUfF]{{0,2}}\'\'\'[\s\S]*?(?:\'\'\'|\z)|#[^\n]*+|[rRbBuUfF]{{0,2}}{_DOUBLE}|[rRbBuUfF]{{0,2}}{_SINGLE}|{_LINE}|{_REST}',
    "rust": rf"{_BLOCK}|//[^\n]*+|#!?\[|r(#+)\"[\s\S]*?(?:\"\1|\z)|{_DOUBLE}|'(?:\\u\{{[0-9a-fA-F_]++\}}|\\?[^'\n])'|{_LINE}|{_REST}",
    "other": rf"{_BLOCK}|//[^\n]*+|{_DOUBLE}|{_SINGLE}|`[^`]*+`|{_LINE}|{_REST}",
}


def _language(path: Column) -> Column:
    return F.when(path.rlike(r"\.pyi?$"), "python").when(path.rlike(r"\.rs$"), "rust").otherwise("other")


def _count(text: Column, what: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, what, ""))


def source_texts(source_files: DataFrame) -> DataFrame:
    """One row per file with a text: file_path, text, n_lines. Of differing rows the greatest text."""
    one = source_files.filter("file_path is not null and text is not null").groupBy("file_path").agg(F.max("text").alias("text"))
    lines = _count(F.col("text"), "\n") + F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    return one.select("file_path", "text", lines.alias("n_lines"))


def _hidden(text: Column) -> Column:
    for pair, sign in _ESCAPED.items():
        text = F.replace(text, F.lit(pair), F.lit(sign))
    return text


def _shown(text: Column) -> Column:
    for pair, sign in _ESCAPED.items():
        text = F.replace(text, F.lit(sign), F.lit(pair))
    return text


def lexed(texts: DataFrame) -> DataFrame:
    """(file_path, i, t, python, kind, turn, brace, breaks, newline, lead): the tokens of every text."""
    language = _language(F.col("file_path"))
    hidden = texts.select("file_path", _hidden(F.col("text")).alias("text"), language.alias("language"))
    split = lambda x: F.regexp_extract_all("text", F.lit(LEXERS[x]), F.lit(0))
    tokens = F.when(F.col("language") == "python", split("python")).when(F.col("language") == "rust", split("rust")).otherwise(split("other"))
    # the outer form: an inner one would let the optimizer lex every text a second time for a filter
    rows = hidden.select("file_path", (F.col("language") == "python").alias("python"), F.posexplode_outer(tokens).alias("i", "t"))
    rows = rows.filter("t is not null").filter(~F.col("t").rlike(r"^[ \t]+$") | (F.col("i") == 0))
    t, python = F.col("t"), F.col("python")
    newline = t.rlike(r"^\r?\n")
    comment = t.rlike(r"^(//|/\*)") | (t.startswith("#") & ~t.rlike(r"^#!?\[") & python)
    string = t.rlike(r"^([rRbBuUfF]{0,2}|r#+)(\"|'|`)") & (F.char_length("t") > 1)
    turn = F.when(t.isin("(", "[", "#[", "#![") | (python & (t == "{")), 1).when(t.isin(")", "]") | (python & (t == "}")), -1).otherwise(0)
    brace = F.when(~python & (t == "{"), 1).when(~python & (t == "}"), -1).otherwise(0)
    w = Window.partitionBy("file_path").orderBy("i")
    return rows.select(
        "file_path", "i", "t", "python", newline.alias("newline"), F.when(comment, "comment").when(string, "string").alias("kind"), turn.alias("turn"), brace.alias("brace"),
        _count(t, "\n").alias("breaks"), F.coalesce(F.lag(newline).over(w), F.lit(True)).alias("lead"),
    )


def placed_tokens(texts: DataFrame) -> DataFrame:
    """The tokens with line, depth of brackets, level of braces and the number of blank lines before."""
    w = Window.partitionBy("file_path").orderBy("i")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.concat("t", *[F.coalesce(F.lead("t", k).over(w), F.lit("")) for k in (1, 2, 3)])
    before = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    return lexed(texts).select(
        "*", (before("breaks") + 1).alias("line"), before("turn").alias("depth"), before("brace").alias("level"),
        F.sum(F.when(F.col("newline") & F.col("lead"), 1).otherwise(0)).over(w).alias("blanks"), ahead.alias("ahead"),
    )


def headed_rows(texts: DataFrame) -> DataFrame:
    """(file_path, line, code, comment, opening): for each line that starts outside brackets, the line of
    code that its island ends in, the last comment of the island, and the string that opens the body."""
    t = F.col("t")
    w = Window.partitionBy("file_path").orderBy("i")
    kind = F.coalesce("kind", F.when(t.isin("#[", "#![") | t.startswith("@"), "mark").otherwise("code"))
    single = placed_tokens(texts).filter(F.col("lead") & ~F.col("newline") & (F.col("depth") <= 0)).select("file_path", "i", "line", (F.col("line") + F.col("breaks")).alias("end_line"), kind.alias("kind"), "t", "blanks", "ahead")
    # lines of comment that follow each other are one comment, however many they are
    remark = (F.col("kind") == "comment") & t.rlike("^(//|#)")
    goes_on = remark & F.lag(remark).over(w) & (F.lag("line").over(w) == F.col("line") - 1)
    runs = single.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    rows = runs.groupBy("file_path", "run").agg(
        F.min("i").alias("i"), F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.min("kind").alias("kind"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("t"), F.min("blanks").alias("blanks"), F.min("ahead").alias("ahead"),
    )
    after_code = ~F.lag("kind").over(w).isin("comment", "mark")
    fresh = F.coalesce(after_code | (F.lag("blanks").over(w) != F.col("blanks")), F.lit(True))
    following = F.when(F.lead("kind").over(w) == "comment", F.struct(F.lead("kind", 2).over(w).alias("kind"), F.lead("t", 2).over(w).alias("t"))).otherwise(F.struct(F.lead("kind").over(w).alias("kind"), F.lead("t").over(w).alias("t")))
    marked = rows.select("*", fresh.cast("int").alias("fresh"), following.alias("next"))
    numbered = marked.withColumn("island", F.sum("fresh").over(w))
    whole = Window.partitionBy("file_path", "island").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    body = F.when((F.col("kind") == "code") & (F.col("next.kind") == "string"), F.col("next.t"))
    tied = numbered.select(
        "file_path", "line", "end_line", F.last(F.when(F.col("kind") == "comment", F.col("t")), ignorenulls=True).over(whole).alias("comment"),
        F.last(F.when(F.col("kind") == "code", F.col("ahead")), ignorenulls=True).over(whole).alias("code"),
        F.last(body, ignorenulls=True).over(whole).alias("opening"),
    )
    tied = tied.withColumns({c: _shown(F.col(c)) for c in ("comment", "opening")})
    return tied.select("file_path", F.explode(F.sequence("line", "end_line")).alias("line"), "code", "comment", "opening")


def block_ends(texts: DataFrame) -> DataFrame:
    """(file_path, line, block_end): for each line of code that a block of braces belongs to, the line
    that closes it. On one level an opening brace and its closing one follow each other."""
    at = placed_tokens(texts).filter(~F.col("python"))
    level = F.when(F.col("t") == "}", F.col("level") - 1).otherwise(F.col("level"))
    head = F.col("lead") & ~F.col("newline") & (F.col("depth") <= 0) & F.col("kind").isNull() & ~F.col("t").isin("{", "}", "#[", "#![")
    marks = at.filter(F.col("t").isin("{", "}") | head).select("file_path", "i", "line", level.alias("level"), F.when(F.col("t").isin("{", "}"), F.col("t")).otherwise("head").alias("what"))
    w = Window.partitionBy("file_path", "level").orderBy("i")
    nth = lambda c, k: F.lead(c, k).over(w)
    seen = marks.select("file_path", "line", "what", nth("what", 1).alias("one"), nth("what", 2).alias("two"), nth("line", 2).alias("block_end"))
    return seen.filter("what = 'head' and one = '{' and two = '}'").groupBy("file_path", "line").agg(F.max("block_end").alias("block_end"))


def comment_text(c: Column) -> Column:
    """A comment or string without its marks."""
    c = F.regexp_replace(c, r"^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(/\*+!?|\*/|\*(?!/)|//[/!]*|#(?![\[a-z])) ?|\*/\s*$", "")
    return F.regexp_replace(c, r"\r|^\s+|\s+$", "")


# How placeholders, references, directives and tags are usually written.
_PLACEHOLDER = (
    r"(?i)^\W*(todo|fixme|xxx|tbd|hack|wip)\b.*$|^\W*(n/?a|none|null|empty|placeholder|undocumented|missing (doc(string|umentation)?s?|description|comment)|"
    r"(no|add|insert|write|needs?|missing|todo) (an? )?(doc(string|umentation)?s?|descriptions?|comments?)( here| yet| available)?|"
    r"(description|documentation|docs?|docstring) (goes here|here|pending|missing|to follow|follows|to be (added|written)|tbd|todo)|"
    r"auto-?generated( method| function)?( stub)?|generated( method| function)? stub|(beschreibung|dokumentation) (folgt|fehlt)|to be (documented|written|added|done)|lorem ipsum.*|document (me|this))\W*$"
)
_REFERENCE = r"(?i)^\W*(ditto|idem|(see|same as|like|cf\.?|refer to|siehe)\b( also| the)? ?[`{@#:\w.()/}-]*( (above|below|parent|class|docs?|documentation|method|function|interface|module))?|(as )?(above|below)|inherit(s|ed)?( ?doc)?(umentation)?)\W*$"
_DIRECTIVE = (
    r"(?i)^\W*(eslint|prettier|tslint|jshint|jslint|jscs|stylelint|biome|oxlint|deno|istanbul|c8|v8|webpack|vite|sonar|nosonar|noqa|nosec|pylint|flake8|mypy|pyright|pyre|ruff|bandit|isort|yapf|black|fmt|autopep8|"
    r"rustfmt|clippy|cspell|codespell|spell-?checker|coverage|pragma|type|ts|flow|noinspection|suppress|checkstyle|formatter|editorconfig|end ?region|region|go|lint|doctest)"
    r"(\s*:{1,2}|-|\b)\s*(ignore|disable|enable|skip|off|on|no|all|noqa|cover|next|expect|nocheck|strict|fixme|helpers|[a-z_-]+::?[a-z_-]+)?(?:[-:=\s,][\w\s,:=./-]*)?$"
)
_REGION = r"(?i)^\W*#?(end)?region\b.*$"
_TAG_LINE = r"^\s*(?:[@\\](?:param|arg|argument|property|prop|throws|exception|raises|returns?|yields?|type|typedef|template|see|link)\b\s*(?:\{[^}]*\})?(?:\s*\[?[\w.$]+\]?(?=\s*$|\s+-?\s*\S|\s*$))?|:(?:param|arg|type|raises?|returns?|rtype|yields?)\b[^:\n]*:)"
_SECTION = r"(?i)^\s*(#+\s*)?(args|arguments|parameters|params|returns?|raises|yields|examples?|errors|panics|safety|notes?|throws)\s*:?\s*$"
_BARE_TAG = r"\{?@\w+\}?(?:\s+[\w.$]+)?"
_CODE = (
    r"^\s*(?:>>>.*|(?:return|throw|raise|yield|await)\b.*[;\])]|(?:let|const|var|val|auto|static|pub|fn|def|class|import|from|use|if|for|while|elif|else|switch|match|with|try)\b.*[;{}:=].*|"
    r"[\w.\[\]]+(?:\s*:\s*[\w<>\[\]]+)?\s*(?:=|\+=|-=|:=)\s*\S.*|[\w.:]+\((?:[^()]|\([^()]*\))*\)\s*[;,]?|.*;\s*|[{}\[\]();,]+)$"
)
_FILLER = "the a an this that these it its function functions func fn method methods routine procedure helper to of for and or in on with is are does do will used simply just".split()


#: Ends of words that go, in order: so tally, tallys and tallies are one word, as are split and splitting.
_ENDINGS = [(r"(ing|ed|es|s|e)$", ""), (r"([b-df-hj-np-tv-xz])\1$", "1"), (r"(ie|y)$", "i")]


def _stem(w: Column) -> Column:
    for ending, instead in _ENDINGS:
        w = F.regexp_replace(w, ending, "$1" if instead == "1" else instead)
    return w


def _stem_of(word: str) -> str:
    for ending, instead in _ENDINGS:
        word = re.sub(ending, r"\1" if instead == "1" else instead, word)
    return word


def _name_words(c: Column) -> Column:
    split = F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))
    return F.transform(F.filter(F.split(split, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != ""), _stem)


def is_trivial(doc: Column, name: Column) -> Column:
    """True if a documentation says no more than the name, or is nothing but placeholders, references,
    tags without text, directives, decoration or code. Null counts as trivial."""
    lines = F.split(doc, r"\n")
    kept = F.filter(lines, lambda x: ~(x.rlike(_PLACEHOLDER) | x.rlike(_REFERENCE) | x.rlike(_DIRECTIVE) | x.rlike(_REGION) | x.rlike(_SECTION) | x.rlike(_CODE)))
    texts = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _TAG_LINE, " "), r"^\s*" + _BARE_TAG + r"\s*$|\{@\w+[^}]*\}", " "), r"^\s*[\w*]+( \([\w, ]+\))?:\s*$", " "))
    rest = F.array_join(texts, " ")
    words = F.filter(_name_words(rest), lambda w: ~w.isin([*_FILLER, *map(_stem_of, _FILLER)]))
    known = _name_words(name)
    return F.coalesce(~rest.rlike(r"[\p{L}\p{N}]") | (F.size(F.array_except(words, known)) == 0), F.lit(True))


def coded(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Each FUNCTION or METHOD whose lines are given, in order and inside the text of its file."""
    functions = nodes.filter(F.col("type").isin("FUNCTION", "METHOD") & F.col("id").isNotNull()).select(
        F.col("id").alias("node_id"), "name", "file_path", "start_line", "end_line", F.get_json_object("metadata", "$.doc").alias("own")
    ).distinct()
    return functions.filter("start_line <= end_line and start_line >= 1").join(texts.select("file_path", "n_lines"), "file_path").filter("end_line <= n_lines")


def documented(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node_id, name, file_path, start_line, end_line, doc) of each FUNCTION or METHOD with code in the
    texts of `source_texts` and a documentation that says something."""
    heads = headed_rows(texts)
    own = F.when(F.col("own").rlike(r"[^\s\p{Z}\p{Cc}]"), F.col("own"))
    tied = coded(nodes, texts).join(heads.withColumnRenamed("line", "start_line"), ["file_path", "start_line"], "left")
    # the comment above, unless it is blank and the body opens with a string
    found = F.filter(F.array("comment", "opening"), lambda c: comment_text(c).rlike(r"[\p{L}\p{N}]"))
    any_ = F.coalesce(F.try_element_at(found, F.lit(1)), F.col("comment"), F.col("opening"))
    doc = F.coalesce(own, comment_text(any_))
    return tied.select("node_id", "name", "file_path", "start_line", "end_line", doc.alias("doc")).filter(~is_trivial(F.col("doc"), F.coalesce("name", F.lit(""))))


def found_ids(nodes: DataFrame, source_files: DataFrame) -> DataFrame:
    return documented(nodes, source_texts(source_files)).select("node_id").distinct()


def pairs(nodes: DataFrame, source_files: DataFrame) -> DataFrame:
    """(node_id, name, code, doc) of each FUNCTION or METHOD with code and a documentation that says something.

    Code: the file has a non-null text, both lines are given, in order and inside it; the function ends
    where its block does, or at the given line where no block opens (as in Python). Documentation: the
    node's own ``doc``; if that is missing or blank, the comment directly above the definition or, in
    Python, the string that opens its body. Metadata that can't be read counts as missing, repeated rows
    count once, rows without an id are ignored. Empty tables give no rows; texts are read whole. The
    noncharacters U+FDD0 to U+FDD3 of a source text come out of a comment as escaped quotes.
    """
    texts = source_texts(source_files)
    found = documented(nodes, texts).join(texts.select("file_path", "text"), "file_path")
    ended = found.join(block_ends(texts).withColumnRenamed("line", "start_line"), ["file_path", "start_line"], "left")
    last = F.coalesce("block_end", "end_line")
    code = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line").cast("int"), (last - F.col("start_line") + 1).cast("int")), "\n")
    return ended.select("node_id", "name", code.alias("code"), "doc")
