"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ewpanel.llm.common import text_slices, utf8_parts

SEGMENT = 256  # symbols parsed at a time; a phrase ends where a segment ends
DENSE = 126  # symbols of a language whose steps are a table
NEW_PHRASE = np.int32(-(1 << 31))
_codes: list[np.ndarray] = []


def _lowered() -> np.ndarray:
    """For every code point the code point of its lower-case letter, 0 where it is no letter."""
    if not _codes:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _codes.append(table)
    return _codes[0]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: for each state the next state by symbol; state 0 is the empty match."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


class Language:
    """The automaton of one language's sample over its own letters.

    Steps on its ``DENSE`` most frequent symbols are a table [state, column], those on
    its other symbols a sorted array of (state, symbol) with the next states, so no
    letter of a sample is left out and the table's width doesn't follow the alphabet.
    A step that leaves the automaton carries NEW_PHRASE and leads where a new phrase that
    begins with the symbol stands. The last row of the table is where a text begins
    and what follows a symbol the sample doesn't have: every step from it is a new phrase.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        found, counts = np.unique(symbols, return_counts=True)
        common = found[np.lexsort((found, -counts))][:DENSE]
        self.bits, self.n_symbols = np.log2(max(2, len(symbols))), n_symbols
        self.size = len(common) + 2  # the common symbols, a symbol that is not in the sample, padding
        self.column = np.full(n_symbols + 2, len(common), np.int32)
        self.column[common] = np.arange(len(common))
        self.column[n_symbols + 1] = len(common) + 1
        self.rare = np.zeros(n_symbols + 2, bool)
        self.rare[found] = True
        self.rare[common] = False
        nexts = automaton(symbols.tolist())
        start = np.full(self.size, len(nexts) * self.size, np.int32)
        for s, q in nexts[0].items():
            if not self.rare[s]:
                start[self.column[s]] = q * self.size
        table = np.tile(start | NEW_PHRASE, (len(nexts) + 1, 1))
        edges: dict[int, int] = {}
        for state, steps in enumerate(nexts):
            for s, q in steps.items():
                if self.rare[s]:
                    edges[state * n_symbols + s] = q * self.size
                else:
                    table[state, self.column[s]] = q * self.size
        table[:, -1] = np.arange(len(nexts) + 1, dtype=np.int32) * self.size
        self.table, self.begin = table.ravel(), np.int32(len(nexts) * self.size)
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.to = keys, np.array([edges[k] for k in keys.tolist()], np.int32)

    def _rare_step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        find = lambda key: np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        key = (state // self.size).astype(np.int64) * self.n_symbols + symbol
        at, first = find(key), find(symbol.astype(np.int64))
        return np.where(self.keys[at] == key, self.to[at], self.to[first] | NEW_PHRASE)

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Number of phrases of each column of symbols, all columns step by step."""
        state, phrases = np.full(lanes.shape[1], self.begin, np.int32), np.zeros(lanes.shape[1], np.int32)
        for symbols in lanes:
            moved = self.table.take(state + self.column.take(symbols))
            if len(self.keys) and len(at := np.flatnonzero(self.rare.take(symbols))):
                moved[at] = self._rare_step(state[at], symbols[at])
            phrases -= moved >> 31
            state = moved & np.int32(0x7FFFFFFF)
        return phrases


class CrossParser:
    """For each language the automaton of its sample; parses texts against all of them.

    Symbols are letters in lower case; any run of other characters is one separator. A
    text's cost for a language is its number of phrases (each the longest match in the
    sample) times log2 of the sample's length, for each symbol: the cross-entropy
    estimate of cross parsing. Texts are parsed ``segment`` symbols at a time, where
    a phrase ends. The cheapest language wins, of equals the first by code point.
    """

    def __init__(self, samples: dict[str, str], segment: int = SEGMENT):
        self.names, self.segment = sorted(samples), segment
        lowered = _lowered()
        points = {k: lowered[np.frombuffer(samples[k].encode("utf-32-le", "ignore"), np.uint32)] for k in self.names}
        known = np.unique(np.concatenate([*points.values(), np.zeros(1, np.uint32)]))  # 0 first: the separator
        self.other, self.pad = len(known), len(known) + 1  # a letter of no sample; padding
        to = np.zeros(0x110000, np.uint32)
        to[known] = np.arange(len(known))
        self.symbol = np.where(lowered > 0, np.where(to[lowered] > 0, to[lowered], self.other), 0).astype(np.uint32)
        self.languages = []
        for k in self.names:
            s = to[points[k]]
            self.languages.append(Language(s[(s != 0) | (np.concatenate([[0], s[:-1]]) != 0)], len(known)))

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts one after another, the n + 1 offsets, and whether each text has a letter."""
        data, offsets = utf8_parts(texts)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        marks = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        if marks[-1] == len(points):
            offsets = marks[offsets]
        else:  # bytes that are no UTF-8
            own = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        s = self.symbol[points]
        before = np.zeros_like(s)
        before[1:] = s[:-1]
        before[offsets[:-1][offsets[:-1] < len(s)]] = 0
        keep = (s != 0) | (before != 0)
        total = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(s != 0)])
        return s[keep], total[offsets], letters[offsets[1:]] > letters[offsets[:-1]]

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each text for each language [text, language], and whether the text has a letter."""
        s, offsets, has = self.symbols(texts)
        sizes = np.diff(offsets)
        parts = -(-sizes // self.segment)
        owner = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[:-1][owner] + nth * self.segment
        length = np.minimum(self.segment, offsets[1:][owner] - start)
        out = np.zeros((len(sizes), len(self.names)))
        if not len(owner):
            return out, has
        padded = np.append(s, np.full(self.segment, self.pad, s.dtype))
        lanes = np.lib.stride_tricks.sliding_window_view(padded, self.segment)[start].T.copy()
        lanes[np.arange(self.segment)[:, None] >= length[None, :]] = self.pad
        for k, language in enumerate(self.languages):
            out[:, k] = np.bincount(owner, language.phrases(lanes), len(sizes)) * language.bits / np.maximum(sizes, 1)
        return out, has


def fit_samples(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                sample_chars: int = 1 << 15, total_chars: int = 1 << 18, least_chars: int = 1 << 10, piece_chars: int = 4096) -> dict[str, str]:
    """A bounded sample of text for each language of the labelled rows.

    At most ``sample_chars`` characters a language and about ``total_chars`` in all, but
    at least ``least_chars`` for each, in pieces of at most ``piece_chars`` of documents
    in the order of a hash of their id. Every language is learned; these bounds are the
    model's size and grow with the number of languages, not with the corpus.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h"), F.substring(F.col(text_col).cast("string"), 1, piece_chars).alias("piece"))
    stats = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece").cast("long")).alias("chars"))
    stats = stats.where("chars > 0").orderBy("lang").collect()  # a row for each language
    if not stats:
        return {}
    bound = max(min(least_chars, sample_chars), min(sample_chars, total_chars // len(stats)))
    share = F.create_map(*[x for r in stats for x in (F.lit(r.lang), F.lit(min(1.0, 2.0 * bound / r.chars + 16.0 / r.n)))])
    wanted = rows.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
    out: dict[str, str] = {}
    for r in sorted(wanted.collect(), key=lambda r: (r.lang, r.h, r.piece)):
        if len(text := out.get(r.lang, "")) < bound:
            out[r.lang] = text + r.piece[: bound - len(text)] + "\n"
    return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; true for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. The score is 1 - cost of the best language / cost of the second (1 with
    one language): near 0 where two languages explain the text equally well.
    Repeated rows are each labelled; an empty table gives an empty result; columns
    named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(CrossParser(samples)) if samples else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col, 1 << 20):
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                parser = model.value
                costs, has = parser.costs(batch.column(text_col))
                best = costs.argmin(axis=1)
                pred = [parser.names[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())]
                if costs.shape[1] > 1:
                    two = np.partition(costs, 1, axis=1)[:, :2]
                    score = np.where(has, np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0, 1), 0)
                else:
                    score = has.astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)
