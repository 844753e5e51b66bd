"""Language ID, byte-level BPE and media columns."""

import hashlib
import random
import re
import wave
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from sparkquill.llm import media, queries
from sparkquill.llm.bpe import ByteBpe, as_model, decode, encode, read_ranks, round_trip, stand_ins
from sparkquill.llm.langid import held_out, identify, learn
from sparkquill.llm.media import fingerprints, media_digest, pad, peaks, read_media, store_texts, to_wav
from tests.llm.helpers import docs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n  a", "a" * 30_000, "\0\1 ▁▁ x", "😀🏽‍🚀 ñ", "<|endoftext|></s><unk>", "1234567890123", "don't we'll", "　x", "é" * 50, "名前" * 100, "x \t\r\n y"]


def rows(texts):
    return list(enumerate(texts))


# ---------------------------------------------------------------- language


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(table, learn(table.where(~held_out(table["doc_id"])))).where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) <= 0.02 * len(found)


def test_languages_of_awkward_rows(spark):
    rng = random.Random(1)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    german, spanish = ["der", "die", "und", "nicht", "schön", "straße", "auf"], ["el", "los", "niño", "que", "mañana", "por"]
    known = [(k, say(german, 80), "de") for k in range(30)] + [(100 + k, say(spanish, 80), "es") for k in range(30)] + [(500, "x", None), (501, None, "es"), (None, "the", "en")]
    dictionaries = learn(docs(spark, known), rows=5)
    assert sorted(dictionaries) == ["de", "es"]
    asked = [(1, None), (2, ""), (3, "123 -- !"), (4, say(german, 60)), (5, say(spanish, 60)), (5, say(spanish, 60)), (6, say(german, 100_000)), (None, say(spanish, 50))]
    table = docs(spark, asked).withColumn("score", F.col("doc_id"))
    found = identify(table, dictionaries)
    assert found.columns == [*[c for c in table.columns if c != "score"], "lang_pred", "score", "rejected"]
    assert sorted(((r.doc_id, r.lang_pred, r.rejected) for r in found.collect()), key=repr) == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False), (5, "es", False), (5, "es", False), (6, "de", False), (None, "es", False)], key=repr)
    assert [r.lang_pred for r in identify(docs(spark, asked[3:4]), {}).collect()] == ["und"]
    assert identify(docs(spark, []), dictionaries).count() == 0 and learn(docs(spark, [])) == {}


def test_the_held_out_third(spark):
    table = docs(spark, [(k, "x") for k in (*range(40), -5)])
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in table.select("doc_id", held_out(table["doc_id"]).alias("h")).collect())


def test_long_labelled_texts_are_learned(spark):
    known = [(1, "los niños que " * 2_000, "es"), (2, "der und nicht " * 2_000, "de")]
    dictionaries = learn(docs(spark, known), max_chars=1_000)
    assert sorted(dictionaries) == ["de", "es"] and all(0 < len(d) <= 1_200 for d in dictionaries.values())
    with pytest.raises(ValueError):
        learn(docs(spark, known), max_languages=1)


def test_sizes_are_those_of_coding_each_block_alone(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(table.where(~held_out(table["doc_id"])))

    def size(text, dictionary, level):
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        code = lambda block: zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block)
        return sum(len(code(data[i : i + 2_048])) for i in range(0, len(data), 2_048))

    texts = {r.doc_id: r.text for r in table.where("doc_id % 10 = 3").collect()}
    for r in queries.op2_language_id(spark, sf_dir).where("doc_id % 10 = 3").collect():
        sizes = {lang: size(texts[r.doc_id], d, 7) for lang, d in dictionaries.items()}
        first, second = sorted(sizes.values())[:2]
        if (second - first) / second < 0.05:
            sizes = {lang: n + size(texts[r.doc_id], dictionaries[lang], 12) for lang, n in sizes.items()}
            first, second = sorted(sizes.values())[:2]
        assert r.lang_pred == min(sizes, key=lambda lang: (sizes[lang], lang))
        assert r.score == pytest.approx((second - first) / second) and r.rejected == (r.score < 0.005)


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_ids_are_those_of_merging_by_rank(reference):
    rng = random.Random(7)
    bpe = ByteBpe(as_model(read_ranks(RANKS)), PATTERN, stand_ins())
    texts = [t or "" for t in ODD] + ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(32, 127), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        ids = bpe.encode(text)
        assert list(ids) == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_encoded_columns(spark, reference, sf_dir):
    table = docs(spark, rows(ODD)).unionByName(docs(spark, [(3, "again"), (3, "again"), (None, "no id")]))
    ids = {(r.doc_id, tuple(r.ids)) for r in encode(table, RANKS, PATTERN).collect()}
    assert {(k, tuple(reference.encode_ordinary(t or ""))) for k, t in rows(ODD)} <= ids
    assert decode(encode(table, RANKS, PATTERN), RANKS, PATTERN).count() == len(ODD) + 3
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in round_trip(documents, RANKS, PATTERN).collect():
        own = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert round_trip(docs(spark, []), RANKS, PATTERN).count() == 0


# ---------------------------------------------------------------- media


def test_media_digests(spark):
    table = docs(spark, [*rows(ODD), (77, "x" * 191 + "é"), (78, "same"), (79, "same"), (None, "same"), (78, "same")])
    found = media_digest(table).collect()
    assert len(found) == len(ODD) + 5
    texts = dict(rows(ODD)) | {77: "x" * 191 + "é"}
    for r in found:
        payload = pad((texts.get(r.doc_id, "same") or "").encode())
        assert len(payload) % 192 == 0 and payload
        assert (r.n_bytes, r.payload_bytes) == (len((texts.get(r.doc_id, "same") or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(to_wav(payload)), hashlib.sha256(to_wav(payload)).hexdigest())
    assert len({r.feature for r in found if r.doc_id in (78, 79, None)}) == 1
    assert media_digest(docs(spark, [])).count() == 0


def test_wav_is_what_the_wave_module_reads(spark):
    (row,) = read_media(store_texts(docs(spark, [(1, "hello")]))).collect()
    with wave.open(BytesIO(bytes(row.media))) as file:
        assert file.getparams()[:4] == (1, 1, 8000, 192)
        assert file.readframes(192) == bytes(row.payload) == b"hello" + b" " * 187


def test_peaks_of_a_tone():
    t = np.arange(8000 * 2)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 / 8000 * t)).astype(np.uint8)
    frame, bin_ = peaks(tone)
    assert set(bin_) == {24} and len(frame)  # 1000 Hz of 8000 in 192 samples
    prints = fingerprints(tone.tobytes())
    assert (np.diff(prints & 0xFFFFFFFF) >= 0).all() and set(prints >> 56) == {24}


def by_definition(payload):
    """Fingerprints by sums of cosines and sines, and by sorting all maxima of a block."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    n, angle = (len(x) - 192) // 96 + 1, 2 * np.pi * np.outer(np.arange(192), np.arange(97)) / 192
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(192) / 191)
    frames = np.stack([x[96 * k : 96 * k + 192] * window for k in range(n)])
    power = np.round(np.hypot(frames @ np.cos(angle), frames @ np.sin(angle)), 6)
    chosen = []
    for block in range(0, n, 16):
        found = [(-power[k, b], k, b) for k in range(block, min(n, block + 16)) for b in range(1, 96) if power[k, b] > power[k, b - 1] and power[k, b] >= power[k, b + 1]]
        chosen += sorted((k, b) for _, k, b in sorted(found)[:4])
    pairs = []
    for gap in range(1, 4):
        pairs += [(k, gap, i, (b << 24 | d << 16 | min(m - k, 0xFFFF)) << 32 | k) for i, ((k, b), (m, d)) in enumerate(zip(chosen, chosen[gap:], strict=False))]
    return [code for *_, code in sorted(pairs, key=lambda p: p[:3])]


@pytest.mark.parametrize("n", [10, 1_000, 250_000])
def test_fingerprints_are_those_of_the_definition(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    payload = pad(" ".join(rng.choice(words) for _ in range(n // 5)).encode())
    assert fingerprints(payload).tolist() == by_definition(payload)


def test_equal_peaks_go_by_frame_and_bin():
    payload = pad(b"aabb" * 48 * 40)  # the same frame again and again
    frame, bin_ = peaks(np.frombuffer(payload, np.uint8))
    assert frame[:4].tolist() == [0, 1, 2, 3] and len(set(bin_[:4].tolist())) == 1
    assert fingerprints(payload).tolist() == by_definition(payload)


def test_long_texts_are_transformed_in_passes(monkeypatch):
    payload = pad(("%d " * 40_000 % (*range(40_000),)).encode())
    whole = fingerprints(payload)
    monkeypatch.setattr(media, "PASS", 3)
    assert len(payload) > 2 * 96 * 16 * 64 and fingerprints(payload).tolist() == whole.tolist()


def test_digest_of_the_registered_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_media_columns(spark, sf_dir).collect():
        payload = pad((texts[r.doc_id] or "").encode())
        prints = by_definition(payload) if r.doc_id % 10 == 0 else fingerprints(payload).tolist()
        assert r.feature == f"{len(prints)}:{hashlib.sha256(','.join(map(str, prints)).encode()).hexdigest()}"
        assert r.media_sha256 == hashlib.sha256(to_wav(payload)).hexdigest()
