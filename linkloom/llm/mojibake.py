"""Texts that were decoded with the wrong character encoding, and their originals.

Lines are states of a search: every step encodes a line with one encoding and decodes it with another,
or resolves character entities. The cheapest state is expanded first; the cost of a state is the number
of bits of its pairs of signs under a model of the corpus itself, and states already seen are not
visited again.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import spread

#: Steps on one path of the search.
DEPTH = 5
#: Bits by which a text must become cheaper, and as a share of its cost: for UTF-8 read as something
#: else, which hardly arises by chance, and for one 8-bit encoding read as another.
UTF8_BITS, UTF8_SHARE = 7.0, 0.05
SINGLE_BITS, SINGLE_SHARE, SINGLE_SIGNS = 18.0, 0.08, 6
#: Bits by which a state may be dearer than the cheapest one.
SLACK_BITS = 24.0
#: Bits a pair above what is usual for its script, from which swaps of 8-bit encodings are tried.
ODD_BITS = 2.0
#: Share of a word's and of a line's signs above ASCII that must be UTF-8 sequences; in alphabets that
#: are not Latin such signs stand side by side in any text, so nearly all of a word must.
LATIN_SHARES, OTHER_SHARES = (0.51, 0.0), (0.85, 0.0)
#: In these code pages small letters are parts of sequences, so most signs of the line must be in some.
DENSE, DENSE_SHARE = ("cp866", "cp737"), 0.8
_CHARGE = 22.0  # bits of a control character or replacement mark

# Encodings that texts are read in by mistake.
SINGLE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp1253", "iso8859-7", "cp1254", "iso8859-9", "iso8859-15", "cp1257", "cp437", "cp850", "cp852", "cp866", "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic", "iso8859-5", "cp737"]
TRUE_SINGLE = ["cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1253", "iso8859-7", "cp1254", "cp437", "cp850", "cp852", "mac-roman"]
MULTI = ["gbk", "gb18030", "big5", "cp932", "euc-jp", "euc-kr"]

_QUOTED = re.compile(r"`[^`\n]{1,40}`|[\"'][^\x00-\x7f]{1,4}[\"']")
_SEQUENCE = re.compile(b"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_OTHER = {"cp1251", "cp1253", "iso8859-7", "cp866", "koi8-r", "koi8-u", "mac-cyrillic", "iso8859-5", "cp737"}
# signs that a text may hold; scripts of which a few bytes give single signs by chance are left out
_USUAL = re.compile("[\x00-\x7f\xa0-\u02af\u02c6-\u02dd\u0300-\u0345\u0370-\u045f\u0490-\u0491\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u22ff\u2300-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufb01-\ufb02\ufe0f\uff00-\uffef\U0001f000-\U0001faff\U0001d400-\U0001d7ff\U00020000-\U0002ffff\ufeff\x80-\x9f]*")
_MIXED = re.compile("[\u3041-\u9fff\uac00-\ud7a3](?=[\u00c0-\u052f])|[\u00c0-\u052f](?=[\u3041-\u9fff\uac00-\ud7a3])")
_FOREIGN = re.compile("[\u0530-\u0fff\u1f00-\u1fff]{3,}")
_LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|\?\?+(?=[^\W\d_])|(?<=[^\W\d_])\?\?+(?=\s[^\W\d_])")
# neighbouring words of which nothing is left
_LOST_WORDS = re.compile(r"(?<!\S)\?{2,}(?:[ \t,.;:]+\?{2,})+(?!\w)")
# signs above ASCII that are spelled out, as numbers or names
_ESCAPE = re.compile(r"&#(?:1[2-9]\d|[2-9]\d\d|\d{4,7});|&#[xX][0-9a-fA-F]{2,6};|&[A-Za-z]{3,8}\d?;|\\u[0-9a-fA-F]{4}")
_CODED = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_WIDE = re.compile("[　-鿿가-힯｡-ﾟ]")
_HIGH_WORD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*[^\x00-\x7f][^ \t\r\n]*")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def _table(encoding: str) -> list[str]:
    """Byte to sign; bytes that the encoding leaves out pass as control characters."""
    return [chr(b) if b < 128 else bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


def _unlike(table: list[str]) -> list[str]:
    """A table without repeated signs, as building an encoder needs it."""
    seen: set[str] = set()
    return [c if c not in seen and not seen.add(c) else "\ufffe" for c in table]


class _Codecs:
    def __init__(self):
        self.tables = {e: _table(e) for e in {*SINGLE, *TRUE_SINGLE}}
        # sign to byte, of the upper half; signs without a byte go to a place that is no byte
        self.bytes = {e: {ord(c): b for b, c in reversed(list(enumerate(t))) if b > 127} for e, t in self.tables.items()}
        self.encoders = {e: codecs.charmap_build("".join(_unlike(t))) for e, t in self.tables.items()}
        self.decoders = {e: "".join(t) for e, t in self.tables.items()}
        self.pairs = {}
        for read in SINGLE:
            for true in TRUE_SINGLE:
                if read != true:
                    same = {c: self.tables[true][b] for c, b in self.bytes[read].items()}
                    if any(chr(c) != x for c, x in same.items()):
                        self.pairs[read, true] = same
        # every first byte of a sequence starts a search; where a code page has everyday letters in the
        # place of first and later bytes (all small ones), the second byte must be another sign
        two, more = [*range(0xC2, 0xE0)], [*range(0xE0, 0xF5)]
        small = {"cp866": range(0xA0, 0xB0), "cp737": range(0x98, 0xB0)}
        # bits of the encodings in which a sign begins or goes on with a sequence
        self.leads2, self.leads3, self.seconds, self.trails = (np.zeros(0x10000, np.uint32) for _ in range(4))
        for k, e in enumerate(SINGLE):
            t, after = self.tables[e], range(0x80, 0xC0)
            second = [b for b in after if b not in small.get(e, ())]
            for mask, places in ((self.trails, after), (self.seconds, second), (self.leads2, two), (self.leads3, more)):
                mask[[ord(t[b]) for b in places]] |= np.uint32(1 << k)

    def starts(self, signs: np.ndarray) -> np.ndarray:
        """Of each sign but the last two the encodings, as bits, in which a sequence of UTF-8 begins there."""
        plane = np.where(signs < 0x10000, signs, 0).astype(np.int64)
        a, b, c = plane[:-2], plane[1:-1], plane[2:]
        return (self.leads2[a] & self.trails[b]) | (self.leads3[a] & self.seconds[b] & self.trails[c])

    def readings(self, text: str) -> int:
        """The encodings, as bits, in which the text holds a sequence of UTF-8."""
        return int(np.bitwise_or.reduce(self.starts(np.frombuffer((text + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32))))

    def worth_a_look(self, texts: list[str]) -> np.ndarray:
        """True for texts with a possible start of UTF-8 read as something else, East Asian signs or escapes."""
        signs = np.frombuffer(("\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = signs[:-2]
        hit = (self.starts(signs) > 0) | ((first >= 0x3000) & (first < 0xD7A4)) | ((first > 0xFF60) & (first < 0xFFA0))
        line = np.cumsum(signs == 10) - (signs == 10)
        return (np.bincount(line[:-2][hit], minlength=len(texts))[: len(texts)] > 0) | np.array([_ESCAPE.search(x) is not None for x in texts])

    def utf8(self, text: str, encoding: str, size: int) -> str | None:
        """Bytes of ``encoding`` read as UTF-8, in words that are mostly such sequences."""
        # one byte a sign: what the encoding doesn't have becomes "?"
        t = codecs.charmap_encode(text, "replace", self.encoders[encoding])[0]
        found = list(_SEQUENCE.finditer(t))
        in_word, in_line = OTHER_SHARES if encoding in _OTHER else LATIN_SHARES
        in_line = DENSE_SHARE if encoding in DENSE else in_line
        high = size * in_line
        if not found or sum(f.end() - f.start() for f in found) < high:
            return None
        out, at, k, done = [], 0, 0, 0
        for word in _HIGH_WORD.finditer(text):
            own = []
            while k < len(found) and found[k].start() < word.end():
                own.append(found[k])
                k += 1
            size = sum(f.end() - f.start() for f in own)
            if not own or size < in_word * sum(map(len, _HIGH.findall(word.group()))):
                continue
            new, here = [], word.start()
            for f in own:
                new += [text[here : f.start()], f.group().decode("utf-8", "replace")]
                here = f.end()
            fresh = "".join([*new, text[here : word.end()]])
            if _USUAL.fullmatch(_FOREIGN.sub("", fresh)) and not _MIXED.search(fresh):
                out += [text[at : word.start()], fresh]
                at, done = word.end(), done + size
        return "".join([*out, text[at:]]) if done and done >= high else None

    def multi(self, text: str, encoding: str) -> str | None:
        """Runs of signs encoded by a multi-byte encoding and read as UTF-8, with little loss."""
        changed = False

        def run(m: re.Match) -> str:
            nonlocal changed
            w = m.group()
            try:
                new = w.replace("�", "?").encode(encoding).decode("utf-8", "replace")
            except UnicodeError:
                return w
            if not any(ord(c) > 127 and c != "�" for c in new):
                return w  # nothing but marks in another form
            if new.count("�") > 0.34 * len(new) + w.count("�") or len(new) >= len(w) and len(w) > 2:
                return w
            changed = True
            return new

        new = re.sub(r"[^\x00-\x7f]{2,}", run, text)
        return new if changed else None

    def steps(self, text: str, swap: bool, readings: int) -> Iterator[str]:
        """The states one step away: by UTF-8, or by swaps of 8-bit encodings. Encodings that give the
        signs of this text the same bytes are one; of swaps only those are tried that know the signs."""
        high = {c for run in _HIGH.findall(text) for c in run}
        signs = [ord(c) for c in sorted(high)]
        known: dict[tuple, str] = {}
        for k, e in enumerate(SINGLE):
            if swap or readings >> k & 1:
                known.setdefault(tuple(map(self.bytes[e].get, signs)), e)
        if not swap:
            size = sum(map(len, _HIGH.findall(text)))
            for key, e in known.items():
                if len(key) - key.count(None) >= 2 and (new := self.utf8(text, e, size)):
                    yield new
            if _WIDE.search(text):
                yield from filter(None, (self.multi(text, e) for e in MULTI))
        else:
            for key, read in known.items():
                lacking = sum(b is None for b in key)
                if lacking > 0.1 * len(key):
                    continue
                raw = None if lacking else codecs.charmap_encode(text, "strict", self.encoders[read])[0]
                tried = set()
                for true in TRUE_SINGLE:
                    table = self.tables[true]
                    signs_there = tuple(b and table[b] for b in key)
                    if (read, true) in self.pairs and signs_there not in tried:
                        tried.add(signs_there)
                        yield codecs.charmap_decode(raw, "strict", self.decoders[true])[0] if raw else text.translate(self.pairs[read, true])


def _classes() -> np.ndarray:
    """Sign to class, for the basic plane: letters of alphabets stand for themselves, the rest by kind.

    There are fewer than 1,700 classes, so a model has fewer than 2.9 million pairs for any corpus.
    """
    c = np.full(0x10000, 0x2F00)
    c[:0x80] = 32
    for low, high in ((0x61, 0x7B), (0x80, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150)):
        c[low:high] = np.arange(low, high)
    c[0x30:0x3A] = 0x30
    c[0xA0] = c[0xA0]
    for low in range(0x2190, 0x2C00, 0x10):
        c[low : low + 0x10] = low
    for k, (low, high) in enumerate(((0x530, 0x590), (0x590, 0x600), (0x600, 0x700), (0x900, 0xE00), (0xE00, 0xE80), (0x1100, 0x1200), (0x1E00, 0x2000), (0x3000, 0x3040), (0x3040, 0x30A0), (0x30A0, 0x3100), (0x3400, 0x4E00), (0x4E00, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xF900), (0xFF00, 0xFFF0), (0xFFFD, 0xFFFE))):
        c[low:high] = 0x2F01 + k
    return c


_CLASS = _classes()
_MARK = int(_CLASS[0xFFFD])


def _pairs_of(texts: list[str], across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring signs, one of them not ASCII, and the number of the text each is in; with
    ``across`` also the pairs of the end of a text and the first sign of the next one."""
    joined = "\n".join(texts).lower() + "\n"
    signs = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(signs == 10) - (signs == 10)
    plane = np.where(signs < 0x10000, signs, 0xFFFF)
    kind = _CLASS[plane]
    high = signs > 127
    keep = np.flatnonzero((high[1:] | high[:-1]) & (across | (signs[:-1] != 10)))
    return kind[keep].astype(np.int64) << 16 | kind[keep + 1], line[keep]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        if len(f):
            keys, n = np.unique(_pairs_of(list(f["line"]), across=True)[0], return_counts=True)
            yield pd.DataFrame({"pair": keys, "n": n.astype(np.int64)})


def _script(pairs: np.ndarray) -> np.ndarray:
    """0 Latin, 1 Greek, 2 Cyrillic, 3 other, by the sign of a pair that isn't ASCII."""
    sign = np.where((pairs & 0xFFFF) > 127, pairs & 0xFFFF, pairs >> 16)
    return np.searchsorted([0x250, 0x400, 0x530], sign, "right")


class _Model:
    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, counts = pairs[order], counts[order]
        total = max(1.0, float(counts.sum()))
        self.bits = -np.log2((counts + 0.5) / total)
        self.unseen = min(24.0, float(-np.log2(0.5 / total)) + 1)
        script = _script(self.pairs)
        self.usual = np.bincount(script, counts * self.bits, minlength=4) / np.maximum(1, np.bincount(script, counts, minlength=4))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text, and by how much a pair of it exceeds what is usual for its script."""
        keys, line = _pairs_of(texts)
        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        bits = np.where(self.pairs[at] == keys, self.bits[at], self.unseen) if len(self.pairs) else np.full(len(keys), self.unseen)
        second = keys & 0xFFFF
        # control characters and replacement marks belong to no text, however many garbled ones have them
        bits = np.where(((second >= 0x80) & (second < 0xA0)) | (second == _MARK), np.maximum(bits, _CHARGE), bits)
        n = len(texts)
        excess = np.bincount(line, bits - self.usual[_script(keys)], minlength=n)[:n] / np.maximum(1, np.bincount(line, minlength=n)[:n])
        return np.bincount(line, bits, minlength=n)[:n], excess


def _unescaped(text: str) -> str:
    """The state one unescape step away: entities, and signs coded by number."""
    text = html.unescape(text) if "&" in text else text
    if "\\u" in text:
        coded = _CODED.sub(lambda m: chr(int(m[1], 16)), text)
        text = coded.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # two halves are one sign
    return text


def _changed(old: str, new: str) -> list[str]:
    """The words that differ, so that a line is judged by what was changed and not by its length."""
    a, b = old.split(" "), new.split(" ")
    if len(a) != len(b):
        return [old, new]
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return [" ".join(x) for x in zip(*pairs, strict=True)] if pairs else ["", ""]


def _odd(text: str, excess: float) -> bool:
    return excess >= ODD_BITS and sum(map(len, _HIGH.findall(text))) >= SINGLE_SIGNS


def _search(text: str, coders: _Codecs, model: _Model, known: tuple[float, float] | None = None) -> str:
    """The cheapest text that can be reached, if it is so much cheaper that the given one is garbled;
    else the given one. States up to SLACK_BITS dearer than the cheapest one are expanded too, and the given
    text by all its steps, so that a way may lead uphill and no early find hides a better one. ``known`` is
    what the model says of the text."""
    # signs in escapes have cost nothing so far: what is measured is the text they spell out, but to spell
    # them out restores nothing
    plain = _unescaped(text)
    costs, excesses = ([known[0]] * 2, [known[1]] * 2) if known and plain == text else model.of([text, plain])
    best, best_cost = text, float(costs[1])
    # of one state, the steps by UTF-8 come before the swaps, of which one is allowed on a path
    heap = [(float(costs[k]), 0, k, t, False, float(excesses[k])) for k, t in enumerate([text, plain] if plain != text else [text])]
    seen = {text, plain}
    while heap:
        cost, swap, depth, state, swapped, excess = heapq.heappop(heap)
        if depth >= DEPTH or (depth and cost > best_cost + SLACK_BITS):
            continue
        if not swap and not swapped and _odd(state, excess):
            heapq.heappush(heap, (cost, 1, depth, state, swapped, excess))
        readings = 0 if swap else coders.readings(state)
        if not swap and not readings and not _WIDE.search(state) and "&" not in state:
            continue
        new = [s for s in coders.steps(state, bool(swap), readings) if s not in seen]
        if not swap and "&" in state:
            new.append(_unescaped(state))
        new = list(dict.fromkeys(s for s in new if s not in seen))
        if not new:
            continue
        seen.update(new)
        swapped = swapped or bool(swap)
        need, share = (SINGLE_BITS, SINGLE_SHARE) if swapped else (UTF8_BITS, UTF8_SHARE)
        bits, excesses = model.of(new)
        for s, c, x in zip(new, bits.tolist(), excesses.tolist(), strict=True):
            if c < best_cost:
                before, after = float(costs[1]), c
                if before - after < max(need, share * before) and not swapped:
                    # a swap changes all signs above ASCII, but the other steps may change a single word
                    before, after = model.of(_changed(plain, s))[0].tolist()
                if before - after >= max(need, share * before):
                    best, best_cost = s, c
            if c < best_cost + SLACK_BITS:
                heapq.heappush(heap, (c, 0, depth + 1, s, swapped, x))
    return best


def _marks(text: str) -> bool:
    """Question marks in the place of letters: twice beside letters, or six as neighbouring words."""
    return len(_LOST.findall(text)) >= 2 or any(m.count("?") >= 6 for m in _LOST_WORDS.findall(text))


def _damaged(text: str) -> bool:
    """Signs that belong to no text: what was lost in their place can't be restored by any step."""
    return "\ufffd" in text or ("?" in text and _marks(text)) or bool(_CONTROL.search(text))


def _is_example(quoted: str) -> bool:
    return not quoted.isascii() or bool(_ESCAPE.search(quoted))


def _repair(pairs: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders, model = _Codecs(), _Model(pairs, counts)
        for f in batches:
            if not len(f):
                continue
            lines = list(f["line"])
            bare = [_QUOTED.sub(" ", x) for x in lines]
            costs, excess = model.of(bare)
            look = coders.worth_a_look(bare)
            rows = []
            for i, (x, b) in enumerate(zip(lines, bare, strict=True)):
                if not (look[i] or _odd(b, excess[i]) or _damaged(b)):
                    continue
                # what is quoted beyond ASCII is an example: it is taken out of the search and stays
                quotes = [q for q in _QUOTED.findall(x) if _is_example(q)]
                held = _QUOTED.sub(lambda m: "\x01" if _is_example(m.group()) else m.group(), x) if quotes else x
                fixed = _search(held, coders, model, (float(costs[i]), float(excess[i])) if held == b else None)
                left = _damaged(_QUOTED.sub(" ", fixed))
                if fixed != held or left:
                    whole = re.sub("\x01", lambda _, q=iter(quotes): next(q), fixed)
                    rows.append((f["key"].iat[i], f["at"].iat[i], whole if fixed != held else None, left))
            yield pd.DataFrame(rows, columns=["key", "at", "fixed", "damaged"])

    return run


def garbled_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, fixed, damaged) of each garbled line: its number, its restored text, null where nothing
    could be restored, and whether something stays lost.

    Null and empty texts have no lines. Quoted sequences (in backticks, or a few signs in quotation
    marks) are examples and stay as they are. Rows that occur twice give rows of their own; long lines
    are searched whole; an empty table gives no rows.
    """
    lines = documents.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    # beyond signs above ASCII, all that _LOST and _LOST_WORDS may accept, and escapes
    marks = F.contains("line", F.lit("?")) & F.col("line").rlike(r"[A-Za-z]\?[A-Za-z]|\?\?")
    escapes = (F.contains("line", F.lit("&")) | F.contains("line", F.lit("\\u"))) & F.col("line").rlike(_ESCAPE.pattern)
    lines = spread(lines.filter((F.octet_length("line") != F.char_length("line")) | marks | escapes))
    counted = lines.select("line").mapInPandas(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    model = counted.toPandas()  # fewer than 2.9 million pairs, see _classes
    kind = dict(lines.dtypes)["key"]
    return lines.mapInPandas(_repair(model["pair"].to_numpy(np.int64), model["n"].to_numpy(np.float64)), f"key {kind}, at int, fixed string, damaged boolean").withColumnRenamed("key", key)


def garbled(documents: DataFrame) -> DataFrame:
    return garbled_lines(documents).select("doc_id").distinct()


def _mended(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            texts = []
            for text, at, fixed in zip(f["text"], f["at"], f["fixed"], strict=True):
                lines = text.split("\n")
                for i, line in zip(at, fixed, strict=True):
                    lines[i] = line
                texts.append("\n".join(lines))
            yield pd.DataFrame({key: f[key], "text": texts, "damaged": f["damaged"]})

    return run


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, damaged) of the affected documents, with every line that could be restored."""
    lines = garbled_lines(documents, key, text)
    fixes = lines.groupBy(key).agg(F.collect_set(F.when(F.col("fixed").isNotNull(), F.struct("at", "fixed"))).alias("fixes"), F.max("damaged").alias("damaged"))
    whole = documents.select(key, F.col(text).alias("text")).join(fixes, key).select(key, "text", F.col("fixes.at").alias("at"), F.col("fixes.fixed").alias("fixed"), "damaged")
    return whole.mapInPandas(_mended(key), whole.select(key, "text", "damaged").schema)
