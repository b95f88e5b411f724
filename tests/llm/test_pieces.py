import hashlib

import sentencepiece
from pyspark.sql import functions as F

from opsframe.llm import pieces

TEXTS = [" a\n\tb ", "", "   ", "x   y", "ﬁ Ａ", "中文😀 日本語テキスト", "a▁b", "<s> </s> <unk>", "\x00\x01", "a" * 300, "/" * 70,
         "https://example.com/a?b=c&d=1", "def f(x):\n    return x**2  # ok", "Ünïcödé straße  naïve", "!!!! ... ---- ====",
         "1234567890 12.50", "Привет мир, как дела?", "مرحبا بالعالم", "ooooooxoxoxoo", " " * 40 + "x", "́‍"]


def test_the_path_is_that_of_the_merges(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    mine = pieces.Transducer(pieces.MODEL)
    for text in TEXTS + [r.text for r in docs.collect() if r.text is not None]:
        ids = mine.encode(text)
        assert ids == model.encode(text), text[:80]
        assert mine.decode(ids) == model.decode(ids) == text.replace(pieces.MARK, " ")


def test_all_paths_of_short_words_by_hand():
    """Among all segmentations just one passes the neighbour acceptor."""
    mine = pieces.Transducer(pieces.MODEL)

    def paths(word):
        return [[]] if not word else [
            [word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in mine.ids for rest in paths(word[n:])
        ]

    for word in ("▁hello", "▁thtion", "aaaaa", "▁▁▁x", "inging"):
        passing = [p for p in paths(word) if all(mine.neighbours(a, b) for a, b in zip(["", *p], p))]
        assert len(passing) == 1 and [mine.ids[p] for p in passing[0]] == mine.shortest_path(word)


def test_query_and_odd_tables(docs, odd, none):
    for df in (docs, odd):
        rows = pieces.round_trip(df).collect()
        assert len(rows) == df.count() and all(r.same for r in rows)
    by_id = {r.doc_id: r for r in pieces.round_trip(odd).collect()}
    assert by_id[3].n_ids == 0 and by_id[3].decoded_sha256 is None
    assert by_id[4].n_ids == 0 and by_id[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.round_trip(none).count() == 0


def test_columns_ride_along(odd):
    wide = odd.withColumns({"ids": F.lit("old"), "value": F.lit(1), "row": F.lit(2)})
    out = pieces.encode(wide)
    assert set(out.columns) == set(wide.columns) and dict(out.dtypes)["ids"] == "array<int>"
    assert {r.row for r in out.collect()} == {2}


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([([1, 3 + 0xE4, 2],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in pieces.decode(df).collect()] == ["�", None, ""]
