"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary file of a byte-pair model with byte fallback is read once per task.  A
batch of texts becomes one array of characters, cut wherever no vocabulary piece holds
the two neighbouring characters side by side: no merge can ever cross such a place, so
the cuts are exact.  The distinct cut-out sequences are held as one ragged array; in
each round every sequence finds its best-ranked (leftmost) neighbouring pair and all
sequences apply theirs at once, until none has a pair left.  What survives is counted;
a character outside the vocabulary counts as its UTF-8 bytes.

Sequences beyond ``LONG`` symbols (text without blanks) are linked arrays instead: ranks
are taken in order, and each rank merges all its places in all sequences at once, from
left to right and up to the first one that makes a pair of no worse rank.  A rank whose
merges keep making such pairs (runs of blanks, whose pieces all have one score) is after
``TRIES`` rounds finished from left to right, place by place: each merge is followed at once
by what it makes possible.  A place is looked at for each rank of its own pairs only, so
a sequence of any length takes little more than linear time.

Defined results: null and empty texts have 0 tokens; texts are counted whole, whatever
their length; repeated rows give repeated results; an empty table gives an empty result;
further columns pass through, the columns that are added replace those of the same name.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm._scratch import text_slices
from segspark.llm._words import mix

SPACE = 0x2581
NONE = np.iinfo(np.int32).max
#: Symbols from which on a sequence is merged rank by rank.
LONG = 48
#: Rounds of one rank before the rest of its places is merged one after another.
TRIES = 8
#: Distinct sequences whose counts a task keeps; beyond it, it starts anew.
CACHED = 1 << 20
_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


class PieceVocabulary:
    """Merge tables of a piece model: which characters join, which pairs merge, and their ranks."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        real = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in real}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        chars = sorted({c for p in pieces for c in p})
        ids = {c: i for i, c in enumerate(chars, 1)}  # 0: not in the vocabulary
        ids |= {p: i for i, p in enumerate((p for p in pieces if len(p) > 1), len(chars) + 1)}
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.size = len(ids) + 1
        merges = []
        for p, score in pieces.items():
            for i in range(1, len(p)):
                self.joins[ids[p[i - 1]], ids[p[i]]] = True
                if (a := ids.get(p[:i])) and (b := ids.get(p[i:])):
                    merges.append((a * self.size + b, ids[p], order[score]))
        merges.sort()
        self.pair, merged, rank = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.merged, self.rank = merged.astype(np.int32), rank.astype(np.int32)

    @cached_property
    def ways(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol by pair."""
        return dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist())))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: they don't merge) and merged symbol of each pair."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        found = self.pair[at] == key
        return np.where(found, self.rank[at], NONE), self.merged[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left in each sequence; ``symbols`` holds the sequences one after another."""
        long = lengths > LONG
        if not long.any():
            return self._merge_short(symbols, lengths)
        out, apart = np.empty(len(lengths), np.int64), np.repeat(long, lengths)
        out[long] = self._merge_long(symbols[apart], lengths[long])
        if not long.all():
            out[~long] = self._merge_short(symbols[~apart], lengths[~long])
        return out

    def _merge_long(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        sym, size = symbols.copy(), len(symbols)
        starts = np.cumsum(lengths) - lengths
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[starts + lengths - 1], before[starts] = -1, -1
        rank, into, merged = np.full(size, NONE, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rate(at: np.ndarray) -> None:
            """Look the pairs that start at ``at`` up and queue those that merge."""
            rank[at] = NONE
            at = at[after[at] >= 0]
            rank[at], into[at] = self.look_up(sym[at], sym[after[at]])
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                queue(int(rank[part[0]]), part)

        def queue(r: int, at: np.ndarray) -> None:
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(at)

        def in_turn(at: np.ndarray, r: int) -> np.ndarray:
            """Merge all pairs of rank r, and better ones that they make, from left to right;
            returns where other pairs have come about."""
            s, a, b, k, to, gone = map(memoryview, (sym, after, before, rank, into, merged))
            ways, width, none, changed = self.ways, self.size, (NONE, 0), []
            for p in at.tolist():
                while k[p] <= r:
                    right = a[p]
                    s[p], beyond = to[p], a[right]
                    a[p], k[right], gone[right] = beyond, NONE, 1
                    own = none
                    if beyond >= 0:
                        b[beyond] = p
                        own = ways.get(s[p] * width + s[beyond], none)
                    k[p], to[p] = own
                    left = b[p]
                    ahead = ways.get(s[left] * width + s[p], none) if left >= 0 else none
                    if left >= 0:
                        k[left], to[left] = ahead
                    if min(own[0], ahead[0]) > r:
                        changed += [p] if left < 0 else [left, p]
                    elif ahead[0] <= own[0]:
                        p = left
            return np.unique(np.array(changed, np.int64))

        tries: Counter[int] = Counter()
        rate(np.arange(size))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # still a pair, and still this one
            if not len(at):
                continue
            tries[r] += 1
            if tries[r] > TRIES:
                changed = in_turn(at, r)
                rate(changed[merged[changed] == 0])
                continue
            # Of places that overlap in a chain every second one merges.
            chain = np.concatenate(([False], at[1:] == after[at[:-1]]))
            run = np.arange(len(at))
            run -= np.maximum.accumulate(np.where(chain, 0, run))
            at = at[run % 2 == 0]
            right, made = after[at], into[at]
            beyond = after[right]
            # Pairs that stand after a merge while what is right of it waits; one of no worse
            # rank goes first in its sequence.
            left = before[at]
            joined = np.concatenate(([False], left[1:] == right[:-1]))  # the left neighbour has just merged
            shifted = np.concatenate(([0], made[:-1]))
            other = np.where(joined, shifted, sym[left])
            ahead = np.where(left >= 0, self.look_up(other, made)[0], NONE)
            ahead = np.minimum(ahead, np.where(beyond >= 0, self.look_up(made, sym[beyond])[0], NONE))
            stops = np.flatnonzero(ahead <= r)
            if len(stops):
                owner = np.searchsorted(starts, at, side="right")
                _, first = np.unique(owner[stops], return_index=True)
                last = np.full(len(starts) + 1, len(at))
                last[owner[stops[first]]] = stops[first]
                now = np.arange(len(at)) <= last[owner]
                queue(r, at[~now])
                at, right, made, beyond = at[now], right[now], made[now], beyond[now]
            sym[at], after[at] = made, beyond
            rank[right], merged[right] = NONE, 1
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            rate(np.unique(np.concatenate((at, left[left >= 0]))))
        return lengths - np.add.reduceat(merged, starts)

    def _merge_short(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = lengths.astype(np.int64).copy()
        live, sym, n = np.arange(len(lengths)), symbols, lengths.astype(np.int64)
        last = np.cumsum(n) - 1
        rank = np.full(len(sym), NONE, np.int32)
        into = np.zeros(len(sym), np.int32)
        inner = np.ones(len(sym), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        rank[at], into[at] = self.look_up(sym[at], sym[at + 1])
        while len(live):
            starts = np.cumsum(n) - n
            best = np.minimum.reduceat(rank, starts)
            ended = best == NONE
            if ended.any():
                out[live[ended]] = n[ended]
                keep = np.repeat(~ended, n)
                sym, rank, into, live, n, best = sym[keep], rank[keep], into[keep], live[~ended], n[~ended], best[~ended]
                if not len(live):
                    break
            seq = np.repeat(np.arange(len(n)), n)
            hits = np.flatnonzero(rank == best[seq])
            owner = seq[hits]
            first = np.ones(len(hits), bool)
            first[1:] = owner[1:] != owner[:-1]
            at = hits[first]  # one place in every sequence
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, into = sym[keep], rank[keep], into[keep]
            at = at - np.arange(len(at))  # each earlier sequence lost one symbol
            n = n - 1
            ends = np.cumsum(n)
            begins = ends - n
            for left, ok in ((at, at + 1 < ends), (at - 1, at > begins)):
                x = left[ok]
                rank[x], into[x] = self.look_up(sym[x], sym[x + 1])
            rank[ends - 1] = NONE
        return out


@lru_cache(maxsize=2)
def _vocabulary(model_file: str) -> PieceVocabulary:
    return PieceVocabulary(model_file)


class TokenCounter:
    """Counts the tokens of slices of texts, remembering sequences it has met."""

    def __init__(self, model_file: str):
        self.vocabulary = _vocabulary(model_file)
        self.known, self.counts = np.empty(0, _U), np.empty(0, np.int64)
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(n, 1 << 22), base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice (UTF-8 bytes and text offsets)."""
        v, texts = self.vocabulary, len(offsets) - 1
        if not len(data):
            return np.zeros(texts, np.int64)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
        code[code == 0x20] = SPACE
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        begins = lead[offsets]
        full = begins[1:] > begins[:-1]  # these get a leading space
        code = np.insert(code, begins[:-1][full], SPACE)
        starts = begins[:-1][full] + np.arange(int(full.sum()))
        sym = v.char[code]
        cut = np.ones(len(sym), bool)
        cut[1:] = ~v.joins[sym[:-1], sym[1:]]
        cut[starts] = True
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(sym)))
        tokens = np.ones(len(first), np.int64)
        unknown = sym[first] == 0  # always alone, as it joins nothing
        c = code[first[unknown]]
        tokens[unknown] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        many = np.flatnonzero(length > 1)
        if len(many):
            self._powers(len(sym))
            values = mix(sym.astype(_U) + _U(1)) * self.up[: len(sym)]
            hashes = mix(np.add.reduceat(values, first)[many] * self.down[first[many]])
            distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            tokens[many] = self._of(distinct, first[many][index], length[many][index], sym)[inverse]
        owner = np.searchsorted(starts, first, side="right") - 1
        out = np.zeros(texts, np.int64)
        out[full] = np.bincount(owner, weights=tokens, minlength=len(starts)).astype(np.int64)
        return out

    def _of(self, distinct: np.ndarray, first: np.ndarray, length: np.ndarray, sym: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, distinct)
        inside = at < len(self.known)
        hit = np.zeros(len(distinct), bool)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        out = np.empty(len(distinct), np.int64)
        out[hit] = self.counts[at[hit]]
        new = ~hit
        if new.any():
            n = length[new]
            flat = np.repeat(first[new] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[new] = self.vocabulary.merge(sym[flat], n)
            if len(self.known) + int(new.sum()) > CACHED:
                self.known, self.counts = np.empty(0, _U), np.empty(0, np.int64)
                at = np.zeros(len(distinct), np.int64)
            self.known = np.insert(self.known, at[new], distinct[new])
            self.counts = np.insert(self.counts, at[new], out[new])
        return out


def token_counts(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    made = ["n_bytes", "n_tokens", "over_limit"]
    own = [f for f in docs.schema.fields if f.name not in (*made, text)]
    schema = StructType([*own, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(model_file)
            column = batch.column(len(own))
            size, tokens = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for lo, hi, data, offsets in text_slices(column, 2 << 20):
                size[lo:hi] = np.diff(offsets)
                tokens[lo:hi] = counter.count(data, offsets)
            columns = [*batch.columns[: len(own)], pa.array(size), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in own), *made])

    return docs.select(*(F.col(f"`{f.name}`") for f in own), F.col(f"`{text}`")).mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
