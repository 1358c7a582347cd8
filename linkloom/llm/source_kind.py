"""Generated, minified, vendored and data files among source files, from the manifest alone.

A character trigram model per language is trained on the identifiers in all file names. Three kinds of
evidence come from names: folders that the model finds improbable are foreign, parts of a name that it
finds improbable are mangled, and names that differ in one slot only are templates. Evidence is added
up in bits. Public conventions (names of vendor and build folders, marks of generators), sizes and
lengths of lines add bits of their own; no list decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import clean_path, language_of
from linkloom.session import cut

LANGUAGES = ["rust", "typescript", "javascript", "python", "other"]
#: Bits a sign above the usual name from which a folder is foreign, and what a convention above it adds.
FOREIGN_BITS = 2.0
VENDOR_PRIOR, STORE_PRIOR, VERSION_PRIOR = 1.2, 3.0, 1.0
#: Bits by which lines are longer than usual in the language, from which a file is minified; improbable
#: parts of its name add to them.
MINIFIED_BITS, MINIFIED_LEAST = 5.0, 2000
#: Bits by which a file is larger than usual in the language, from which it is data.
DATA_BITS = 7.0
#: Bits of the largest usual size and of the longest usual line.
USUAL_SIZE, USUAL_LINE = 14.0, 6.0
#: A template: bits by which its files are larger than usual, as a mean with a few files of the prior;
#: share of distinct fillers of the slot (of so many files, as words repeat in more), and of the uses of
#: its token that are in this slot.
TEMPLATE_BITS, TEMPLATE_PRIOR, PRIOR_FILES = 2.0, 3.5, 4
FILLERS, FILLERS_ENOUGH, SLOT_SHARE, UNLISTED_FILES = 0.7, 24, 0.1, 8

# Public conventions of build tools and package managers.
STORES = ["node_modules", "bower_components", "site-packages", "dist-packages", "jspm_packages"]
VENDOR_DIRS = ["vendor", "vendored", "third-party", "third_party", "thirdparty", "3rdparty", "external", "extern", "externals", "contrib", "deps", "upstream"]
BUILD_DIRS = ["gen", "generated", "dist", "out", "build", "target", "coverage", "_build", "_site", ".next", ".nuxt", ".output", "storybook-static", "bazel-out"]  # beside the sources
BUILD_DIRS_ANYWHERE = ["__generated__", "lcov-report", "htmlcov", "__pycache__", "generated-sources"]
SOURCE_DIRS = ["src", "lib", "test", "tests"]
TAIL_MARKS = ["g", "generated", "gen", "designer", "autogen", "autogenerated", "bindings", "pb", "pb2", "grpc", "tab", "min", "bundle"]
HEAD_MARKS = ["zz", "chunk"]
MINIFIED_MARKS = ["min", "bundle", "chunk"]

_LETTERS = "abcdefghijklmnopqrstuvwxyz0?^$"
_N = len(_LETTERS)
_CODE = np.full(0x80, _LETTERS.index("?"), np.int64)
for _i, _c in enumerate(_LETTERS[:26]):
    _CODE[[ord(_c), ord(_c.upper())]] = _i
_CODE[48:58] = _LETTERS.index("0")
_SPLIT = r"[_\-.\s@+]+"


def manifest_files(manifest: DataFrame) -> DataFrame:
    """One row per cleaned path over all snapshots: file_path, size, lines, language."""
    path = clean_path(F.col("file_path"))
    files = manifest.select(path.alias("file_path"), F.col("size").cast("double").alias("size"), F.col("lines").cast("double").alias("lines"), F.lower(F.trim("language")).alias("language"))
    one = files.filter("file_path is not null").groupBy("file_path").agg(F.avg("size").alias("size"), F.avg("lines").alias("lines"), F.max("language").alias("given"))
    language = F.coalesce(language_of(F.col("file_path")), F.when(F.col("given").isin(LANGUAGES), F.col("given")), F.lit("other"))
    return one.select("file_path", "size", "lines", language.alias("language"))


def _grams(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the identifiers in names, as numbers below 30^3, and the identifier each is in;
    the identifiers of a name follow each other."""
    spaced = pc.replace_substring_regex(pc.fill_null(names, ""), r"([a-z0-9])([A-Z])", r"\1_\2")
    joined = "\n".join(pc.replace_substring_regex(spaced, _SPLIT, "\n").to_pylist())
    signs = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(signs == 10)
    codes = _CODE[np.where(signs < 0x80, signs, 0x3F)]
    sizes = np.diff(ends, prepend=-1) - 1
    # ^^name$ of every identifier, one after the other
    word = np.repeat(np.arange(len(ends)), sizes + 3)
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    padded = np.full(len(word), _LETTERS.index("^"), np.int64)
    inner = signs != 10
    owner = np.cumsum(signs == 10) - (signs == 10)
    padded[starts[owner[inner]] + 2 + (np.flatnonzero(inner) - (ends[owner[inner]] - sizes[owner[inner]]))] = codes[inner]
    padded[starts + sizes + 2] = _LETTERS.index("$")
    keep = np.arange(len(word)) - starts[word] < sizes[word] + 1
    keep &= sizes[word] > 0
    at = np.flatnonzero(keep)
    return (padded[at] * _N + padded[at + 1]) * _N + padded[at + 2], word[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for language in LANGUAGES:
            names = b.column(1).filter(pc.equal(b.column(0), language))
            if len(names):
                grams, n = np.unique(_grams(names)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams)), pa.array(grams), pa.array(n)], ["language", "gram", "n"])


class NameModel:
    """Conditional bits of the last sign of every trigram, and of the usual one: a table of a fixed size,
    whatever the input."""

    def __init__(self, counts: pd.DataFrame):
        self.bits, self.usual = {}, {}
        for language in LANGUAGES:
            own = counts[counts["language"] == language]
            n = np.zeros(_N**3)
            n[own["gram"].to_numpy(np.int64)] = own["n"].to_numpy(np.float64)
            of = np.repeat(n.reshape(-1, _N).sum(1), _N)
            bits = np.minimum(12.0, -np.log2((n + 0.05) / (of + 2.0)))
            self.bits[language], self.usual[language] = bits, float((n * bits).sum() / max(1.0, n.sum()))

    def excess(self, language: str, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each name the bits a sign above the usual one, and the same of its most improbable
        identifier of six signs or more that is plain ASCII (0 without any)."""
        grams, word = _grams(names)
        bits = self.bits[language][grams]
        parts = pc.add(pc.count_substring_regex(pc.replace_substring_regex(pc.replace_substring_regex(pc.fill_null(names, ""), r"([a-z0-9])([A-Z])", r"\1_\2"), _SPLIT, "\n"), "\n"), 1).to_numpy(zero_copy_only=False)
        name = np.repeat(np.arange(len(names)), parts)
        words = len(name)
        n, total = np.bincount(word, minlength=words), np.bincount(word, bits, minlength=words)
        foreign = np.bincount(word, (grams // _N) % _N == _LETTERS.index("?"), minlength=words)
        whole = np.bincount(name, total, minlength=len(names)) / np.maximum(1, np.bincount(name, n, minlength=len(names))) - self.usual[language]
        single = np.where((n >= 7) & (foreign == 0), total / np.maximum(1, n) - self.usual[language], 0.0)
        worst = np.zeros(len(names))
        np.maximum.at(worst, name, single)
        return whole, worst


def _score(model: NameModel):
    """(file_path, language, stem, folder) to (file_path, foreign, mangled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            foreign, mangled = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for language in LANGUAGES:
                own = pc.equal(b.column(1), language)
                at = np.flatnonzero(own.to_numpy(zero_copy_only=False))
                if len(at):
                    foreign[at] = model.excess(language, b.column(3).filter(own))[0]
                    mangled[at] = model.excess(language, b.column(2).filter(own))[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(foreign), pa.array(mangled)], ["file_path", "foreign", "mangled"])

    return run


def name_model(files: DataFrame) -> NameModel:
    """Trained on the stems of all files; at most 30^3 rows for each language reach the driver."""
    counts = files.select("language", _stem().alias("stem")).mapInArrow(_count, "language string, gram bigint, n bigint")
    return NameModel(counts.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas())


def _name() -> Column:
    return F.element_at(F.split("file_path", "/"), -1)


def _stem() -> Column:
    return F.regexp_extract(_name(), r"^(.[^.]*)", 1)


def _slot(end: str) -> Column:
    """The separator and first or last token of a name with more than one, as `.generated` or `zz_`."""
    low = F.lower(F.regexp_replace(_name(), r"\.[A-Za-z0-9]+$", ""))
    found = F.regexp_extract(low, r"[^._-]([._-][a-z0-9]+)$" if end == "tail" else r"^([a-z0-9]+[._-])[^._-]", 1)
    return F.nullif(found, F.lit(""))


def templates(files: DataFrame) -> DataFrame:
    """(slot) of names that are templates, from files with slots and ``larger``, bits above the usual size.

    A slot is a template if its token keeps to it, ever new names fill it, and its files are larger than
    those written by hand; a mark of generators counts as a few larger files that were seen before.
    """
    tokens = F.filter(F.split(F.lower(_name()), r"[._-]"), lambda t: t != "")
    uses = files.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    rest = F.regexp_replace(F.lower(_name()), r"\.[a-z0-9]+$", "")
    spots = files.select("larger", rest.alias("rest"), F.explode(F.array("tail", "head")).alias("slot")).filter("slot is not null")
    groups = spots.groupBy("slot").agg(
        F.count("*").alias("n"), F.sum("larger").alias("sum"), F.coalesce(F.stddev("larger"), F.lit(0.0)).alias("spread"), F.approx_count_distinct("rest", 0.02).alias("fillers")
    )
    token = F.regexp_replace("slot", r"[._-]", "")
    tail = F.col("slot").rlike(r"^[._-]")
    known = groups.withColumn("token", token).join(uses, "token")
    listed = F.when(tail, F.col("token").isin(TAIL_MARKS)).otherwise(F.col("token").isin(HEAD_MARKS))
    with_prior = (F.col("sum") + TEMPLATE_PRIOR * PRIOR_FILES) / (F.col("n") + PRIOR_FILES)
    sure = F.col("sum") / F.col("n") - 2 * F.col("spread") / F.sqrt("n")
    unlisted = (F.col("n") >= UNLISTED_FILES) & (sure >= TEMPLATE_BITS)
    slot = (F.col("fillers") + 1 >= FILLERS * F.least("n", F.lit(FILLERS_ENOUGH))) & (F.col("n") >= SLOT_SHARE * F.col("uses"))
    return known.filter(slot & F.when(listed, with_prior >= TEMPLATE_BITS).otherwise(unlisted)).select("slot", listed.alias("listed"))


def build_folders(files: DataFrame) -> DataFrame:
    """(file_path) of files below a folder that tools write: its name is usual for one, it stands beside
    the sources or has a name that no one else uses, and the files in all such folders are larger."""
    folders = F.split("lower", "/")
    inner = F.slice(folders, 1, F.size(folders) - 1)
    spots = F.filter(F.transform(inner, lambda d, i: F.struct(d.alias("folder"), F.array_join(F.slice(inner, 1, i), "/").alias("above"))), lambda s: s["folder"].isin(BUILD_DIRS + BUILD_DIRS_ANYWHERE))
    outer = F.get(spots, 0)  # what lies deeper tells nothing new
    rows = files.select("file_path", "larger", outer.alias("s")).filter("s is not null").select("file_path", "larger", "s.folder", "s.above")
    # all places of sources, once each
    at = F.filter(F.transform(inner, lambda d, i: F.when(d.isin(SOURCE_DIRS), F.array_join(F.slice(inner, 1, i), "/"))), lambda p: p.isNotNull())
    sources = files.select(F.explode(F.slice(at, 1, 1)).alias("above")).distinct().withColumn("source", F.lit(True))
    placed = rows.join(sources, "above", "left").select("file_path", "larger", "folder", (F.coalesce("source", F.lit(False)) | F.col("folder").isin(BUILD_DIRS_ANYWHERE)).alias("beside"))
    prior = F.when(F.first("beside"), TEMPLATE_PRIOR).otherwise(0.0)
    mean = (F.sum("larger") + prior * PRIOR_FILES) / (F.count("*") + PRIOR_FILES)
    found = placed.groupBy("folder", "beside").agg(mean.alias("mean")).filter(F.col("mean") >= TEMPLATE_BITS / 2)  # of the fixed lists: a few rows
    return placed.join(F.broadcast(found.select("folder", "beside")), ["folder", "beside"], "left_semi").select("file_path").distinct()


def evidence(manifest: DataFrame) -> DataFrame:
    """Every file with its evidence, all of it from one pass over the manifest: file_path, foreign (bits
    a sign, with priors), minified and larger (bits), template, listed, built."""
    files = cut(manifest_files(manifest))
    model = name_model(files)
    size, a_line = F.log2(F.col("size") + 1), F.log2(F.col("size") / F.greatest(F.col("lines"), F.lit(1.0)) + 1)
    # five rows; where most files are data, data still isn't what people write
    middle = lambda c, most: F.least(F.percentile_approx(c, 0.5), F.lit(most))
    usual = files.groupBy("language").agg(middle(size, USUAL_SIZE).alias("usual_size"), middle(a_line, USUAL_LINE).alias("usual_line"))
    segments = F.split("lower", "/")
    inner = F.slice(segments, 1, F.size(segments) - 2)
    # the last folder that is followed by another one and is a store or is meant for foreign code
    last = F.array_max(F.transform(inner, lambda d, i: F.when(d.isin(STORES + VENDOR_DIRS), i + 1).otherwise(0)))
    folder = F.when(last > 0, F.get(segments, last))
    prior = F.when(F.get(segments, last - 1).isin(STORES), STORE_PRIOR).otherwise(VENDOR_PRIOR)
    version = F.when(folder.rlike(r"-\d+(\.\d+)+$"), VERSION_PRIOR).otherwise(0.0)
    wide = cut(files.withColumn("lower", F.lower("file_path")).join(F.broadcast(usual), "language").select(
        "file_path", "language", "lower", "size", "lines", F.coalesce(size - F.col("usual_size"), F.lit(0.0)).alias("larger"), (a_line - F.col("usual_line")).alias("longer"),
        F.regexp_replace(folder, r"-\d+(\.\d+)+$", "").alias("folder"), F.when(last > 0, prior + version).alias("prior"), _slot("tail").alias("tail"), _slot("head").alias("head"),
    ))
    scored = wide.select("file_path", "language", _stem().alias("stem"), F.coalesce("folder", F.lit("")).alias("folder")).mapInArrow(_score(model), "file_path string, foreign double, mangled double")
    slots = templates(wide)
    named = (
        wide.join(slots.withColumnsRenamed({"slot": "tail", "listed": "tail_listed"}), "tail", "left")
        .join(slots.withColumnsRenamed({"slot": "head", "listed": "head_listed"}), "head", "left")
    )
    built = build_folders(wide).withColumn("built", F.lit(True))
    return named.join(scored, "file_path").join(built, "file_path", "left").select(
        "file_path", "size", "larger", (F.col("foreign") + F.col("prior")).alias("foreign"), "mangled",
        (F.col("longer") + F.greatest(F.col("mangled"), F.lit(0.0))).alias("minified"), F.coalesce("tail_listed", "head_listed").alias("template"),
        F.when(F.col("tail_listed").isNotNull(), F.col("tail")).otherwise(F.col("head")).alias("slot"), F.coalesce("built", F.lit(False)).alias("built"),
    )


def classify(manifest: DataFrame) -> DataFrame:
    """file_path, kind of each file that isn't hand-written: vendored, generated, minified or data.

    Rows without a path are ignored; a missing size or line count only removes the evidence that needs
    it; rows of one file, repeated or of several snapshots, are averaged. An empty table gives no rows
    and further columns are not read. Paths and names count whole, however long.
    """
    e = evidence(manifest)
    mark = F.regexp_replace("slot", r"[._-]", "")
    # a template that no list knows tells of a file only if that is large itself
    template = F.col("template") | (F.col("template").isNotNull() & (F.col("larger") >= TEMPLATE_BITS))
    kind = (
        F.when(F.col("foreign") >= FOREIGN_BITS, "vendored")
        .when(F.col("built"), "generated")
        .when((F.col("minified") >= MINIFIED_BITS) & (F.col("size") >= MINIFIED_LEAST) & (F.col("larger") < DATA_BITS + 1), "minified")
        .when(F.col("larger") >= DATA_BITS, "data")
        .when(template, F.when(mark.isin(MINIFIED_MARKS), "minified").otherwise("generated"))
    )
    return e.select("file_path", kind.alias("kind")).filter("kind is not null")
