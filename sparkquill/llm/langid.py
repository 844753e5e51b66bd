"""Language identification by compression: the language whose dictionary codes a text in the fewest bytes.

For each language a sample of labelled texts is a zstandard raw-content dictionary. A text's words, in lower case, are coded
once with each dictionary, in blocks, so that the dictionary stays in reach all along a long text; the smallest total
wins, and the margin to the next one is the confidence. Where it is small the text is coded once more, at a higher level,
and both totals count. A narrow margin rejects the prediction.

Learning reads the labels of all rows for their counts, then draws a bounded sample: up to ``rows`` texts for each
language, and ``max_chars`` characters at most of each, by the order of a hash. Dictionaries are broadcast; their size is bound by
``dictionary_bytes`` times the number of languages (``max_languages`` at most).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import each

UNDETERMINED = "und"
#: Columns of a prediction.
ADDED = ("lang_pred", "score", "rejected")
#: A margin under UNSURE asks for the level AGAIN too.
UNSURE, AGAIN = 0.05, 12
_between_words = re.compile(r"[\W\d_]+").sub


def words(text: str) -> str:
    return _between_words(" ", text.lower())


def learn(labelled: DataFrame, rows: int = 128, max_chars: int = 8_000, dictionary_bytes: int = 65_536, max_languages: int = 400) -> dict[str, bytes]:
    """Language -> dictionary, from labelled (doc_id, text, lang). Rows with a null or without text are left out.

    Texts of any length are drawn, and max_chars characters read of each. A language's dictionary is built in one task from
    about 2 * rows drawn texts; the driver gets dictionaries alone. More than max_languages languages are an error.
    """
    labelled = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").select("lang", F.substring("text", 1, max_chars).alias("text"), F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return {}
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 30) * min(1, 2 * rows / n)) + 1)])

    def build(drawn: pd.DataFrame) -> pd.DataFrame:
        first = sorted(zip(drawn["draw"], drawn["text"], strict=True))[:rows]
        texts = dict.fromkeys(words(text) for _, text in first)
        return pd.DataFrame({"lang": drawn["lang"][:1], "dictionary": ["\n".join(texts).encode()[:dictionary_bytes]]})

    built = labelled.where(F.col("draw") < bound[F.col("lang")]).groupBy("lang").applyInPandas(build, "lang string, dictionary binary")
    return {r["lang"]: bytes(r["dictionary"]) for r in built.collect()}


class Coder:
    """Bytes that a text takes with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 7, block: int = 2_048) -> None:
        self.languages = sorted(dictionaries)
        self.block = block
        self.usual, self.again = ([self._compressor(dictionaries[lang], x) for lang in self.languages] for x in (level, AGAIN))

    @staticmethod
    def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> np.ndarray:
        data = words(text).encode()
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        total = lambda compressors: np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], np.int64)
        sizes = total(self.usual)
        return sizes + total(self.again) if classify(sizes)[1] < UNSURE else sizes


def classify(sizes: np.ndarray) -> tuple[int, float]:
    """(the smallest one, by what part of the next one it is smaller)."""
    order = np.argsort(sizes, kind="stable")
    if len(order) == 1:
        return 0, 1.0
    return int(order[0]), float((sizes[order[1]] - sizes[order[0]]) / sizes[order[1]])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005, level: int = 7, block: int = 2_048) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred, score and rejected.

    lang_pred: a learned language, ``und`` where text is null or has no letter (or nothing was learned); score: the margin,
    0 to 1, 0 for ``und``; rejected: ``und``, or a margin under min_margin. Ties go to the language first in order, with a
    score of 0. Columns of docs of the same names are replaced.
    """
    docs = docs.drop(*ADDED)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, level, block) if shared.value else None
        for batch in each(batches):
            langs, scores = [], []
            for text, lettered in zip(batch.column(0).field("text"), batch.column(1), strict=True):
                if coder is None or not lettered.as_py():
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best, margin = classify(coder.sizes(text.as_py()))
                    langs.append(coder.languages[best])
                    scores.append(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["__row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lettered"))
    kind = rows.schema["__row"].dataType.simpleString()
    found = rows.mapInArrow(run, f"__row {kind}, lang_pred string, score double")
    return found.select(*[F.col("__row").getField(c).alias(c) for c in names], "lang_pred", "score", ((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_margin)).alias("rejected"))


def held_out(doc_id) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
