"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ewpanel.llm.common import Stages, fresh_names, stage_table

#: Between a sentence (with the white space after it) and the next; nothing is lost by the cut.
CUT = r"(?<=[.!?][\x20\x09-\x0D])(?=[^\x20\x09-\x0D])|(?<=\n)(?=[^\x20\x09-\x0D])"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A sentence for ``whole``: to an ASCII stop before white space, a stop of another script or a newline, with closing marks and all white space after it.
BLANK, CLOSING = r"[\s\p{Z}\x{85}]", r"[\p{Pe}\p{Pf}\p{Pi}\"'*_]*"
STOPS = r"[\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{FF61}\x{61F}\x{6D4}\x{964}\x{965}\x{1362}\x{1367}\x{104B}\x{17D4}\x{589}\x{2026}]"
STOPS_LIE = r"\x{589}-\x{FF61}"  # tested before the single stops, and what is no possible end is passed over first: a seventh of the time
SENTENCE = rf"(?s)[^.!?\n{STOPS_LIE}]*+.*?(?:[.!?]{CLOSING}{BLANK}+|(?=[{STOPS_LIE}]){STOPS}+{CLOSING}{BLANK}*|\n{BLANK}*)|.+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LONG = 50  # words from which a repeated sentence alone is a passage


def sentences(text: Column, whole: bool = False) -> Column:
    """The sentences of a text; joined without anything between they are the text."""
    if whole:
        return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)))
    return F.split(text, CUT)


def _n_words(plain: str) -> int:
    """Words between spaces; in scripts without spaces two letters count as a word."""
    return len(plain.split()) + (0 if plain.isascii() else len(UNSPACED.findall(plain)) // 2)


def runs(counts: list[int], run: int, min_words: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of at least ``run`` sentences and ``min_words`` words from each sentence on and up to each.

    A sentence of over LONG words is a run too, and a text of fewer than ``run``
    sentences is one. So every sentence of a passage that has enough words before or
    after it lies in a run inside the passage.
    """
    n, total, out = len(counts), [0], set()
    for c in counts:
        total.append(total[-1] + c)
    size, end = min(run, n), 0
    for i in range(n):
        end = max(end, i + size)
        while end <= n and total[end] - total[i] < min_words:
            end += 1
        if end > n:
            break
        out.add((i, end - 1))
    start = n
    for j in range(n, 0, -1):
        start = min(start, j - size)
        while start >= 0 and total[j] - total[start] < min_words:
            start -= 1
        if start < 0:
            break
        out.add((start, j - 1))
    out.update((i, i) for i, c in enumerate(counts) if c > LONG)
    return out


def _whole_spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """Like ``_spans``, for the runs of ``runs``."""
    plain = docs.select("id", F.xxhash64("text").alias("text_hash"), F.transform(
        sentences(F.col("text"), True), lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " "))).alias("plain"))
    names = ["place", "size", "h1", "h2"]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k in range(batch.num_rows):
                texts = batch.column("plain")[k].as_py()
                for i, j in sorted(runs([_n_words(t) for t in texts], run, min_words)):
                    digest = blake2b("\n".join(texts[i : j + 1]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    row.append(k)
                    found.append((i, j - i + 1, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                if found and (len(found) > 50_000 or k == batch.num_rows - 1):
                    kept = batch.select(["id", "text_hash"]).take(pa.array(row))
                    columns = [pa.array(v, t) for v, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *columns], ["id", "text_hash", *names])
                    row, found = [], []

    fields = [StructField(k, t) for k, t in zip(names, (IntegerType(), IntegerType(), LongType(), LongType()))]
    return plain.mapInArrow(spans, StructType([plain.schema["id"], StructField("text_hash", LongType()), *fields]))


def _spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """id, text_hash, place (of the first sentence), size and the 128-bit hash h1, h2 of every run of sentences."""
    plain = docs.select("id", F.xxhash64("text").alias("text_hash"), F.transform(
        sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(F.lower(s), BETWEEN, " "))).alias("plain"))
    n = F.size("plain")
    size = F.least(F.lit(run), n)
    span = F.explode(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("place"), F.array_join(F.slice("plain", i + 1, size), "\n").alias("words"))))
    spans = plain.select("id", "text_hash", size.alias("size"), span.alias("span"))
    spans = spans.select("id", "text_hash", F.col("span.place").alias("place"), "size", F.col("span.words").alias("words"))
    enough = F.length("words") - F.length(F.translate("words", " \n", "")) >= min_words - 1
    return spans.where(enough).select("id", "text_hash", "place", "size", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))


def substring_dedup(docs: DataFrame, run: int = 2, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Remove sentences that lie in a repeated run and not in its first occurrence.

    Every run of ``run`` consecutive sentences with at least ``min_words`` words is
    hashed (lower case, only letters and digits count; a text with fewer sentences is
    one run) and joined over the whole corpus, copies within a document included. The
    first occurrence is the one with the smallest (id, place), null ids last.
    With ``whole`` sentences also end before closing marks, several white spaces and at
    stops of other scripts, runs grow until they have ``min_words`` (see ``runs``).

    All columns of ``docs`` with the shortened text, plus n_sentences, n_removed and
    removed (places of the sentences, ascending). What stays of a text stays byte by
    byte. Null texts stay null, without sentences; empty texts have one sentence and
    lose none. Rows that repeat an id with the same text are one document and lose the
    same sentences. An empty table gives an empty result. Columns of those three names
    are replaced, all others stay, whatever their names.

    Hot runs: first occurrences are pre-aggregated minima, and the join back of all
    runs is between two plain shuffles, which Spark splits.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    stages = Stages(docs.sparkSession)
    spans = stages.table((_whole_spans if whole else _spans)(source, run, min_words), "sentence-spans")  # texts are cut once for both uses
    first = spans.groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "place")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = stages.table(first.where("times > 1").select("h1", "h2", "first"), "repeated-spans")
    again = spans.join(first, ["h1", "h2"]).where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("place") == F.col("first.place"))))
    gone = again.select("id", "text_hash", F.explode(F.sequence("place", F.col("place") + F.col("size") - 1)).alias("place"))
    gone = stage_table(gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("removed")), "removed-sentences")
    stages.close()
    own_id, own_hash, lost = fresh_names(docs, "_id", "_hash", "_removed")
    gone = gone.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("removed").alias(lost))
    text = F.col(text_col).cast("string")
    kept = F.array_join(F.filter(sentences(text, whole), lambda _, i: ~F.array_contains(lost, i)), "")
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    return joined.withColumns({
        text_col: F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept),
        "n_sentences": F.when(text.isNull(), F.lit(0)).otherwise(F.size(sentences(text, whole))),
        "n_removed": F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)),
        "removed": F.coalesce(lost, F.array().cast("array<int>")),
    }).drop(own_id, own_hash, lost)
