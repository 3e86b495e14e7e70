"""Language identification by compression.

Each language has a raw-content zstandard dictionary: slices of labelled texts. A text is encoded against every dictionary, and the
language with the smallest result is its language. Texts are lower-cased and encoded in pieces of ``PIECE`` bytes, so that what a long
text holds of itself doesn't outweigh the dictionary and memory stays bounded. Where the two best are close, the text is encoded again
by a finer and slower parser, behind zeros that keep the encoder from storing it as it is; what is then still close is told as ``und``
in lang_accepted, while lang_pred names the best. Equal sizes go to the language with more labelled rows, then to the lesser name.

score is the share of the best language when sizes are read as code lengths: 1 / sum(2 ** (8 * (best - size))).

The dictionaries are the classifier, fitted on a bounded sample: for each language the labelled rows are dealt into ``SLICES`` buckets by
a hash of id and text, and the row with the least hash of each bucket gives one slice of at most ``SLICE`` characters, from a place that
the hash names. That is one grouping with partial aggregates, whatever the size or skew of languages, copies or texts. All dictionaries
together have at most ``TOTAL`` bytes, which is what is sent to tasks. More than ``MOST`` labels are an error.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned. Repeated rows and null ids
are rows like others. Columns pass through; lang_pred, score and lang_accepted replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE, SLICES, SLICE, TOTAL, MOST = 4096, 256, 256, 32 << 20, 2000
#: A difference of at most so many bytes, or this share of the smaller size, is narrow: before and after the finer encoding.
NARROW, NARROW_SHARE, STILL = 4, 0.02, 1
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """Names with their dictionaries, the most frequent first."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def learn(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Languages:
    """Dictionaries of all languages that rows with text and label have."""
    rows = labelled.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    names = [r["lang"] for r in rows.select("lang").distinct().limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not names:
        return Languages((), ())
    size = max(8, min(SLICE, TOTAL // (4 * SLICES * len(names))))  # a character has at most four bytes
    hashed = rows.withColumn("h", F.xxhash64("id", "text"))
    start = F.pmod("h", F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1
    # the slice is cut from the rows' least hash alone
    least = hashed.groupBy("lang", F.pmod(F.shiftright("h", 32), F.lit(SLICES)).alias("bucket")).agg(F.min(F.struct("h", F.substring("text", start, F.lit(size)).alias("slice"))).alias("least"), F.count("*").alias("n"))
    found = least.select("lang", "bucket", "least.slice", "n").collect()  # at most SLICES rows a language
    by = {name: sorted((r["bucket"], r["slice"]) for r in found if r["lang"] == name) for name in names}
    count = {name: sum(r["n"] for r in found if r["lang"] == name) for name in names}
    order = sorted(names, key=lambda name: (-count[name], name))
    return Languages(tuple(order), tuple("\n".join(dict.fromkeys(s for _, s in by[name])).lower().encode() for name in order))


def _encoders(dictionaries: tuple[bytes, ...]) -> tuple[list, list]:
    import zstandard as z

    plain = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 4, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    both = []
    for own in ({"strategy": z.STRATEGY_GREEDY, "min_match": 4}, {"strategy": z.STRATEGY_BTULTRA, "min_match": 3}):
        how, row = z.ZstdCompressionParameters(**plain, **own), []
        for content in dictionaries:
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if content else None
            row.append(z.ZstdCompressor(dict_data=dictionary, compression_params=how))
        both.append(row)
    return both[0], both[1]


def _classifier(languages: Languages):
    """text -> (index of the language, score, whether the margin is wide enough)."""
    fast, fine = _encoders(languages.dictionaries)
    zeros = bytes(64)

    def sizes(pieces: list[bytes], encoders: list) -> list[int]:
        return [sum(len(e.compress(p)) for p in pieces) for e in encoders]

    def f(text: bytes) -> tuple[int, float, bool]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        found, gap = sizes(pieces, fast), NARROW
        best, second = sorted(found)[:2] if len(found) > 1 else (found[0], found[0] + 1000)
        if second - best <= max(NARROW, NARROW_SHARE * best):
            found, gap = sizes([zeros + p for p in pieces], fine), STILL
            best, second = sorted(found)[:2]
        return found.index(best), 1 / sum(2.0 ** max(-1000, 8 * (best - s)) for s in found), second - best > gap

    return f


def identify(docs: DataFrame, languages: Languages, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score and lang_accepted."""
    names = languages.names
    kind = "struct<lang_pred: string, score: double, accepted: boolean>"
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("accepted", pa.bool_())]
    held: list = []  # one classifier a task

    @F.arrow_udf(kind)
    def predicted(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(_classifier(languages))
        found = [held[0](t.as_buffer().to_pybytes()) if t.is_valid else (None, 0.0, False) for t in texts.cast(pa.large_binary())]
        columns = [[None if i is None else names[i] for i, _, _ in found], [s for _, s, _ in found], [a for _, _, a in found]]
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields)], fields=fields)

    worded = F.col(text_column).rlike(r"\p{L}") & F.lit(bool(names))
    out = docs.withColumn("__found", predicted(F.when(worded, F.lower(text_column)))) if names else docs.withColumn("__found", F.lit(None).cast(kind))
    lang = F.coalesce("__found.lang_pred", F.lit(UNKNOWN))
    accepted = F.when(F.col("__found.accepted"), lang).otherwise(F.lit(UNKNOWN))
    return out.withColumns({"lang_pred": lang, "score": F.coalesce("__found.score", F.lit(0.0)), "lang_accepted": accepted}).drop("__found")


def held_out(id_column: str = "doc_id") -> Column:
    """One in five rows, by their id; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(True))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), languages).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_accepted")
