from pyspark.sql import functions as F

from linkloom.llm import queries
from linkloom.llm.mojibake import garbled, restored

GERMAN = "Für jede Datei führt der Indexer eine Prüfung durch, die höchstens drei Stück öffnet und ungültige Einträge löscht."
FRENCH = "Le résultat précédent reste accessible tant que la méthode n’a pas été supprimée — même après la clé."
RUSSIAN = "Перед выпуском проверьте, что узел и снимок совпадают построчно, иначе граф будет повреждён."
GREEK = "Ο παλιός δείκτης θα διαγραφεί στην επόμενη έκδοση και μένει μόνο ο κόμβος."
JAPANESE = "古い定義は次の版で削除され、索引だけが残ります。最初に差分を読み込みます。"
CLEAN = [GERMAN, FRENCH, RUSSIAN, GREEK, JAPANESE, "plain words only"]


def read_as(text, wrong, right="utf-8"):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(right))


def run(spark, docs):
    # the corpus that the model is made of: mostly right texts
    rows = list(enumerate(docs)) + [(1000 + i, t) for i, t in enumerate(CLEAN * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit("l"), "at": F.lit(1), "key": F.lit(0)})
    return {r.doc_id for r in garbled(df).collect()}, {r.doc_id: (r.text, r.damaged) for r in restored(df).collect()}


def test_round_trips(spark):
    docs = [
        read_as(GERMAN, "latin-1"), read_as(GERMAN, "cp1252"), read_as(read_as(FRENCH, "cp1252"), "cp1252"), read_as(RUSSIAN, "cp1251"), read_as(RUSSIAN, "cp1252"), read_as(GREEK, "cp1253"),
        read_as(GERMAN, "cp437"), read_as(FRENCH, "mac-roman"), read_as(JAPANESE, "latin-1"), read_as(RUSSIAN, "cp866", "cp1251"), read_as(RUSSIAN, "latin-1", "cp1251"), read_as(GREEK, "latin-1", "iso8859-7"),
        "intact line\n" + read_as(FRENCH, "cp1252") + "\n" + RUSSIAN,
    ]
    want = [GERMAN, GERMAN, FRENCH, RUSSIAN, RUSSIAN, GREEK, GERMAN, FRENCH, JAPANESE, RUSSIAN, RUSSIAN, GREEK, "intact line\n" + FRENCH + "\n" + RUSSIAN]
    found, fixed = run(spark, docs)
    assert found == set(range(len(docs)))
    assert [fixed[i] for i in range(len(docs))] == [(w, False) for w in want]


def test_lost_signs_are_found_and_told(spark):
    found, fixed = run(spark, [GERMAN.encode("latin-1").decode("utf-8", "replace"), "Usuni?to zb?dnych plik�w, wi?c w?ze? jest teraz"])
    assert found == {0, 1} and fixed[0][1] and fixed[1][1]


def test_texts_that_are_right(spark):
    docs = [
        None, "", " ", GERMAN, RUSSIAN.upper(), "If a page shows `Ã©` where `é` was typed, the reader guessed the charset; likewise `â€™`.", "The mark `�` in the golden file is intended.",
        "café vs café, Å vs Å, ﬁ ligature", "Stack 👩\u200d💻 done ✅ 🚀🚀 in 35ms", "𝓐𝟙 \ue000 column 𠀀𠮷", "«СССР» — ответ “да”… 10 × 3 ≤ 40 °C → 5 µs", "a?.b ? c : d", "한국어 색인 1422개, 갱신", "x" * 300_000 + "é",
    ]
    assert run(spark, docs) == (set(), {})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert garbled(df).count() == 0 and restored(df).count() == 0


def test_given_data(spark, sf):
    assert queries.p8_found(spark, sf).columns == ["doc_id"]
    marks = "â€|Ã©|Ã¼|Ã¶|Ã£|Ã³|Ð°Ð|├®|┬á"
    sure = spark.read.parquet(f"{sf}/documents.parquet").filter(F.regexp_replace("text", "`[^`]*`", "").rlike(marks)).select("doc_id")
    assert {r[0] for r in sure.collect()} <= {r[0] for r in queries.p8_found(spark, sf).collect()}


def test_lines_of_which_only_question_marks_are_left(spark):
    lost = [
        "B??d pojawia si?, gdy tre?? jest pusta", "f??r die ??bersicht", "GR?SSE UND L?NGE", "one line\n?????? ???, ?????\nanother line",
        "\u041e\u0448\u0438\u0431\u043a\u0430 \u043f\u0440\u0438 \u0447\u0442\u0435\u043d\u0438\u0438".encode("ascii", "replace").decode(),
    ]
    kept = ["Why? Really??", "a ?? b ?? c", "x?.y ?? z?.w", "What is this???", "unknown: ??? (see above)", "GET /a?b=1", "`?????? ???` is what a reader sees", "?? ??"]
    found, _ = run(spark, lost + kept)
    assert found == set(range(len(lost)))


def coded(text, how):
    return "".join(c if c.isascii() else how(ord(c)) for c in text)


def test_garbled_signs_in_escapes(spark):
    number, unicode_ = lambda c: f"&#{c};", lambda c: f"\\u{c:04x}"
    docs = [coded(read_as(GERMAN, "latin-1"), number), coded(read_as(GERMAN, "latin-1"), unicode_), coded(read_as(RUSSIAN, "latin-1"), lambda c: f"&#x{c:X};"), "f&Atilde;&frac14;r jede Datei"]
    found, fixed = run(spark, docs)
    assert found == {0, 1, 2, 3} and [fixed[i] for i in range(4)] == [(GERMAN, False), (GERMAN, False), (RUSSIAN, False), ("für jede Datei", False)]
    right = [coded(GERMAN, number), coded(RUSSIAN, unicode_), "a &amp; b &lt;c&gt; &nbsp;", "use `&#195;&#188;` or `\\u00c3\\u00bc` for a broken sign", "C:\\users\\u1234 and &copy; 2020"]
    assert run(spark, right)[0] == set()


def test_one_garbled_word_in_a_long_line(spark):
    word = read_as("naïve Prüfung", "cp1252")
    docs = [f"{RUSSIAN * 5} {word} {RUSSIAN * 5}", f"{JAPANESE * 5} {word} {JAPANESE}", f"{RUSSIAN} {read_as('проверьте снимок', 'cp1251')} {RUSSIAN}"]
    found, fixed = run(spark, docs)
    assert found == {0, 1, 2} and "naïve Prüfung" in fixed[0][0] and "naïve Prüfung" in fixed[1][0] and fixed[2][0] == f"{RUSSIAN} проверьте снимок {RUSSIAN}"


def test_signs_with_rare_first_bytes(spark):
    docs = ["Kiểm tra từng tệp tiếng Việt trước khi xóa", "fu\u0308r die Pru\u0308fung der Eintra\u0308ge", "şəhər üçün məlumat bazası və ölçü"]
    found, fixed = run(spark, [read_as(t, "cp1252") for t in docs])
    assert found == {0, 1, 2} and [fixed[i][0] for i in range(3)] == docs
