from __future__ import annotations

import random

import pytest
import zstandard
from compare import SMALL

from conftest import GERMAN, PROSE
from vignette.llm import langid, queries


def test_query_equals_brute_force(spark):
    """Sizes from plain compressors, block by block."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = langid.fit(docs)
    raw = {k: zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, d in made.items()}

    def size(lang: str, text: bytes) -> int:
        p = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK, dict_size=len(made[lang]), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstandard.ZstdCompressor(dict_data=raw[lang], compression_params=p)
        return sum(len(c.compress(text[a : a + langid.BLOCK])) for a in range(0, len(text), langid.BLOCK))

    truth = {r["doc_id"]: r for r in docs.collect()}
    for r in queries.op2_language_id(spark, SMALL).collect():
        text = truth[r["doc_id"]]["text"].lower().encode()
        order = sorted((size(k, text), k) for k in made)
        lead = order[1][0] - order[0][0]
        sure = lead / order[0][0] >= langid.MARGIN and lead >= langid.MARGIN_BYTES
        assert r["lang_found"] == (order[0][1] if sure else None), r


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.languages(docs.where("doc_id % 2 = 1"), made).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 40").collect()
    named = [r for r in got if r["lang_found"] is not None]
    assert len(named) / len(got) > 0.95
    assert sum(r["lang_found"] == r["lang"] for r in named) / len(named) > 0.95


def test_short_texts(spark):
    """One level serves all lengths: held-out texts of up to 256 bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = langid.fit(docs.where("doc_id % 2 = 0"))
    short = docs.where("doc_id % 2 = 1 AND n_chars BETWEEN 40 AND 250")
    got = langid.languages(short, made).join(short.select("doc_id", "lang"), "doc_id").collect()
    named = [r for r in got if r["lang_found"] is not None]
    assert len(got) > 50 and len(named) / len(got) > 0.9
    assert sum(r["lang_found"] == r["lang"] for r in named) / len(named) > 0.95


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    got = langid.languages(df).collect()
    assert len(got) == len(odd_rows) and all(not r["keep"] for r in got if r["doc_id"] in (1, 2))
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    empty = df.limit(0)
    assert langid.fit(empty) == {} and langid.keep_identified(empty).count() == 0
    with_text = sum(bool(t) for _, t, _ in odd_rows)
    assert langid.keep_identified(df, {}).count() == with_text


def texts(n: int, low: int, high: int, prose: str, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = prose.split()
    out = []
    for _ in range(n):
        size, made = rng.randint(low, high), ""
        while len(made) < size:
            made += rng.choice(words) + " "
        out.append(made.strip())
    return out


@pytest.mark.parametrize(("low", "high", "n"), [(41, 199, 30), (20_500, 24_000, 4)])
def test_texts_of_any_length_teach(documents, low, high, n):
    """Tables of short texts only and of long texts only keep their rows."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in texts(n, low, high, PROSE, 1)] + [(t, "de") for t in texts(n, low, high, GERMAN, 2)])]
    df = documents(rows)
    assert set(langid.fit(df)) == {"en", "de"}
    got = langid.languages(df).collect()
    assert sum(r["lang_found"] == rows[r["doc_id"]][2] for r in got) >= 0.9 * len(rows)


def test_what_cannot_be_judged_stays(documents):
    english = [(i, t, "en") for i, t in enumerate(texts(8, 300, 900, PROSE, 3))]
    german = [(10 + i, t, "de") for i, t in enumerate(texts(8, 300, 900, GERMAN, 4))]
    got = langid.languages(documents(english[:2])).collect()
    assert all(r["keep"] and r["lang_found"] is None for r in got) and len(got) == 2
    assert langid.keep_identified(documents(english)).count() == 8  # one language tells nothing apart
    rare = [(20, "Ĉiuj homoj estas denaske liberaj kaj egalaj laŭ digno kaj rajtoj, kaj ili posedas racion kaj konsciencon.", "eo")]
    told = {r["doc_id"]: r for r in langid.languages(documents(english + german + rare)).collect()}
    assert told[20]["keep"] and told[20]["lang_found"] is None
    assert told[3]["lang_found"] == "en" and told[13]["lang_found"] == "de"


def test_copies_count_once_in_the_sample(documents):
    """A text that fills the sample with its copies would leave a dictionary of one passage."""
    many = texts(12, 300, 900, PROSE, 5)
    rows = [(i, t, "en") for i, t in enumerate(many)] + [(100 + i, many[0], "en") for i in range(300)] + [(1000 + i, t, "de") for i, t in enumerate(texts(12, 300, 900, GERMAN, 6))]
    made = langid.fit(documents(rows), sample=8)
    assert made == langid.fit(documents([r for r in rows if not 100 <= r[0] < 1000]), sample=8)
    assert len(langid.fit(documents(rows), size=2000)["en"]) <= 2000
