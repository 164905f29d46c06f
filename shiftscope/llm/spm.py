"""SentencePiece (BPE with byte fallback) encoding and decoding.

Encoding a batch of texts:

1. Texts are normalised (dummy prefix, blanks as U+2581) and cut at points
   no piece can span; each distinct segment is encoded once per batch.
2. The new segments are concatenated and indexed by a suffix array (suffixes
   compared on as many characters as the longest piece has).
3. Every piece of the vocabulary is looked up by binary search, all at once;
   its occurrence range gives the edges (start, end, piece) of the lattice.
4. Edges are sorted by end position and relaxed from left to right: a
   position's last piece is the one edge whose piece may follow the last
   piece at the edge's start.  For merge-ranked vocabularies a sequence is
   the BPE result exactly when each neighbouring pair is (no merge across the
   border would have come first), so this reproduces the model's own merges.

Segments that start with several blanks use pieces that share one rank; they
are merged directly (:meth:`Model.merge`).

The model's pieces and scores are read once on the driver and broadcast (one
vocabulary, its size fixed by the model file); executors need no file.

Defined results: NULL and empty texts encode to an empty list and decode to
''.  U+2581 in a text reads back as a blank, as the format has it.  Repeated
rows are encoded each; extra columns pass through untouched.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK_CHARS = 2_000_000    # characters of text that are encoded together
FRUGAL_CHARS = 500_000     # the same where memory is short: a worker takes about 120 MB less and an eighth more time
CACHE_SEGMENTS = 200_000
RUN_SHARE = 0.4            # of these characters, new segments that are indexed at once (less than all only if frugal)
PAIRS = 1_000_000          # answers about neighbouring tokens that are kept


def read_model(path: str = DEFAULT_MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 ordinary, 1 byte, 2 control or unknown) of a model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kinds = [1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in range(n)]
    return [p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], kinds


class _Numbers(dict):
    """Numbers segments in order of appearance."""

    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        return n


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``count`` of them, for one after the other."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


class Model:
    """Lookup tables of a vocabulary, built once per Python worker."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces, self.n = pieces, len(pieces)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 0}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.encode() for p, k in zip(pieces, kinds)]
        multi = [p for p in self.ids if len(p) > 1]
        self.depth = max(map(len, multi))
        joint = {c for p in multi for c in p}
        if any(BLANK in p.lstrip(BLANK) for p in multi):
            raise ValueError("pieces with a blank inside are not supported")
        # characters of longer pieces without a piece of their own: they merge, but are never ids
        bare = sorted(c for c in joint if c not in self.ids)
        self.tokens = pieces + bare
        self.token_of = dict(self.ids) | {c: self.n + i for i, c in enumerate(bare)}
        letters = sorted(joint)
        self.rank = {c: i + 1 for i, c in enumerate(letters)}
        # cut where no piece goes on: before blanks, and around line breaks
        stop = "" if "\n" in joint else "\n"
        self.segment = re.compile(f"{BLANK}*[^{BLANK}{stop}]+|{BLANK}+" + (f"|{stop}" if stop else ""))
        top = max(map(ord, letters)) + 1
        self.other = len(letters) + 1  # the rank of every character that no longer piece holds
        self.table = np.full(top + 1, self.other, dtype=np.uint16)
        for c, r in self.rank.items():
            self.table[ord(c)] = r
        self.top = top
        # what is searched: every ordinary piece made of joint letters, not starting with several blanks
        self.search = [t for p, t in self.token_of.items() if all(c in joint for c in p) and not p.startswith(BLANK * 2)]
        self.search += [t for p, t in self.ids.items() if len(p) == 1 and p not in joint]
        single = [t for t in self.search if len(self.tokens[t]) == 1 and self.tokens[t] not in joint]
        self.alone = {self.tokens[t]: t for t in single}  # pieces of one character that merge with nothing
        self.search = np.array([t for t in self.search if t not in set(single)], dtype=np.int32)
        self.len = np.array([len(t) for t in self.tokens], dtype=np.int32)
        self.bits = self.other.bit_length()
        self.per = 64 // self.bits     # ranks in a word
        self.levels = self._levels()
        self._made = np.full(len(self.tokens), -1, dtype=np.int8)  # whether the merges make a token, -1: not looked into
        self._slots = np.full(1 << 20, -1, dtype=np.int64)         # 2 * pair + answer, for the pairs last asked about
        self._split: dict[int, tuple] = {}
        self._pair: dict[int, bool] = {}
        # segments that are kept: their number, and by number where their ids are
        self._number = _Numbers()
        self._first, self._size, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _levels(self) -> list[tuple]:
        """The searched pieces by the number of words of ranks they take: for
        each level (tokens, groups, least, greatest last word; groups, words
        that longer pieces go on from).  Pieces of a level are in one group if
        all their words before are equal."""
        out, pieces, group = [], self.search, np.zeros(len(self.search), np.int64)
        for lo in range(0, self.depth, self.per):
            low, high = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.uint64)
            for k, t in enumerate(pieces.tolist()):
                r = [self.rank[c] for c in self.tokens[t][lo:lo + self.per]]
                x = 0
                for i in range(self.per):
                    x = x << self.bits | (r[i] if i < len(r) else 0)
                low[k], high[k] = x, x | (1 << self.bits * (self.per - len(r))) - 1
            ends = self.len[pieces] <= lo + self.per
            on, inv = np.unique(np.array(list(zip(group[~ends].tolist(), low[~ends].tolist())), dtype=np.uint64).reshape(-1, 2),
                                axis=0, return_inverse=True)
            out.append((pieces[ends], group[ends], low[ends], high[ends], on[:, 0].astype(np.int64), on[:, 1]))
            pieces, group = pieces[~ends], inv.ravel().astype(np.int64)
        return out

    # -- merging directly

    def merge(self, s: str) -> list[str]:
        """The model's own merges: best score first, then leftmost."""
        return self._merge(s)[0]

    def _merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        sym, nxt, prv, last = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1)), None
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(sym):
                sc = self.score.get(sym[i] + sym[j])
                if sc is not None:
                    heapq.heappush(heap, (-sc, i, sym[i], sym[j], j))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            if sym[i] != a or j >= len(sym) or sym[j] != b or nxt[i] != j:
                continue
            last = (a, b)
            sym[i], sym[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [x for x in sym if x], last

    def split(self, t: int) -> tuple | None:
        """(left, right) of a token's last merge; () for a single character;
        None if the merges never make this token."""
        got = self._split.get(t, 0)
        if got == 0:
            s = self.tokens[t]
            if len(s) == 1:
                got = ()
            else:
                parts, last = self._merge(s)
                got = (self.token_of[last[0]], self.token_of[last[1]]) if parts == [s] else None
            self._split[t] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves just these two tokens:
        going back through both merge trees along the border, no merge across
        it ranks before the next merge on either side (leftmost on equals)."""
        key = a * len(self.tokens) + b
        got = self._pair.get(key)
        if got is None:
            got = self._pair[key] = self._check(a, b)
        return got

    def _check(self, a: int, b: int) -> bool:
        score, tokens = self.score, self.tokens
        x, y = a, b
        px = py = -np.inf  # score of the merge that takes x (y) away
        while True:
            c = score.get(tokens[x] + tokens[y])
            if c is not None and c > px and c >= py:
                return False
            sx, sy = self.split(x), self.split(y)
            fx = score[tokens[x]] if sx else np.inf  # when x was made
            fy = score[tokens[y]] if sy else np.inf
            if not sx and not sy:
                return True
            # undo the later of the two makings (the lower score; equal: the right one is later)
            if sx and (not sy or fx < fy):
                px, x = fx, sx[1]
            else:
                py, y = fy, sy[0]

    # -- a batch

    def _words(self, ranks: np.ndarray) -> np.ndarray:
        """The next ``per`` ranks of every position as one number, 0 from the segment's end on."""
        n = len(ranks)
        padded = np.concatenate((ranks, np.zeros(self.per, dtype=ranks.dtype)))
        out, inside = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(self.per):
            r = padded[i:i + n]
            inside &= r != 0
            out <<= np.uint64(self.bits)
            out |= np.where(inside, r, 0).astype(np.uint64)
        return out

    def _edges(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, token) of every occurrence of a searched piece: suffixes are
        sorted by their first word of ranks, those that longer pieces share it
        with by the next one too, and so on; a piece's suffixes stand together."""
        words = self._words(ranks)
        at, group = np.arange(len(ranks), dtype=np.int32), None
        starts, toks = [], []
        for level, (tok, g, low, high, on_g, on_word) in enumerate(self.levels):
            key = words[at + level * self.per] if level else words
            lows, highs = np.concatenate((low, on_word)), np.concatenate((high, on_word))
            if level:
                known, key = np.unique(key, return_inverse=True)
                base = np.concatenate((g, on_g)) * len(known)
                lows, highs = base + np.searchsorted(known, lows, "left"), base + np.searchsorted(known, highs, "right") - 1
                key = group * len(known) + key.ravel()
            sa = np.argsort(key)
            key = key[sa]
            lo = np.searchsorted(key, lows, "left")
            count = np.maximum(np.searchsorted(key, highs, "right") - lo, 0)
            mine, on = count[:len(tok)], count[len(tok):]
            starts.append(at[sa[_spans(lo[:len(tok)], mine)]])
            toks.append(np.repeat(tok, mine))
            at, group = at[sa[_spans(lo[len(tok):], on)]], np.repeat(np.arange(len(on)), on)
            if not len(at):
                break
        return np.concatenate(starts), np.concatenate(toks)

    def _are_made(self, toks: np.ndarray) -> np.ndarray:
        """Which of the tokens the merges make."""
        for t in np.unique(toks[self._made[toks] < 0]).tolist():
            self._made[t] = self.split(t) is not None
        return self._made[toks] > 0

    def _follows(self, pairs: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs (first token * number of tokens + second)."""
        slot = (pairs * 0x1E3779B97F4A7C15 >> 24) % len(self._slots)
        held = self._slots[slot]
        out = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != pairs)
        if len(miss):
            size = len(self.tokens)
            uniq, at, inv = np.unique(pairs[miss], return_index=True, return_inverse=True)
            good = np.fromiter((self.may_follow(k // size, k % size) for k in uniq.tolist()), bool, len(uniq))
            out[miss] = good[inv]
            self._slots[slot[miss[at]]] = 2 * uniq + good
        return out

    def encode_segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct segments in a row, and each segment's number
        of ids, by suffix array, lattice and relaxation."""
        codes = np.frombuffer(("\x00".join(segs) + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter(map(len, segs), np.int64, len(segs))
        starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        ends = starts + lens
        n = len(codes)
        ranks = self.table[np.minimum(codes, self.top)]
        ranks[ends] = 0
        e_start, e_tok = self._edges(ranks)
        made = self._are_made(e_tok)
        # characters that no edge covers alone: their own piece, or bytes (marked by -1)
        lone = np.flatnonzero(ranks == self.other).astype(np.int32)
        e_start = np.concatenate((e_start[made], lone))
        e_tok = np.concatenate((e_tok[made], np.full(len(lone), -1, np.int32)))
        e_end = e_start + np.where(e_tok >= 0, self.len[e_tok], 1).astype(np.int32)
        longest = int(lens.max(initial=0))
        place = (np.arange(n) - np.repeat(starts, lens + 1)).astype(np.uint16 if longest < 1 << 16 else np.int64)
        local = place[e_end]
        order = np.argsort(local, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(local, minlength=longest + 1))))
        e_start, e_tok, e_end = e_start[order], e_tok[order], e_end[order]
        last = np.full(n + 1, -2, dtype=np.int32)  # -2: nothing, -1: a character of its own
        last[starts] = -3  # a segment's start
        size = len(self.tokens)
        for j in range(1, longest + 1):
            x, y = bounds[j], bounds[j + 1]
            if x == y:
                continue
            before, tok = last[e_start[x:y]], e_tok[x:y]
            ok = before != -2
            pairs = np.flatnonzero((before >= 0) & (tok >= 0))
            if len(pairs):
                ok[pairs] = self._follows(before[pairs].astype(np.int64) * size + tok[pairs])
            last[e_end[x:y][ok]] = tok[ok]
        # back from every segment's end
        used, at, first = np.zeros(n + 1, bool), ends, starts
        while len(at):
            used[at] = True
            t = last[at]
            at = at - np.where(t >= 0, self.len[t], 1)
            more = at > first
            at, first = at[more], first[more]
        at = np.flatnonzero(used)
        ids = last[at]
        odd = np.flatnonzero((ids < 0) | (ids >= self.n))  # characters without a piece of their own among the ids
        number = np.ones(len(at), np.int64)
        if len(odd):
            chars, inv = np.unique(codes[at[odd] - 1], return_inverse=True)
            lists = [self._lone(chr(c)) for c in chars.tolist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            number[odd] = sizes[inv]
            flat = np.array([i for x in lists for i in x], dtype=np.int32)
            ids = np.repeat(ids, number)
            ids[_spans((np.cumsum(number) - number)[odd], number[odd])] = flat[_spans((np.cumsum(sizes) - sizes)[inv], sizes[inv])]
        total = np.concatenate(([0], np.cumsum(number)))
        bound = np.concatenate(([0], np.searchsorted(at, ends, "right")))
        return ids, np.diff(total[bound])

    def _lone(self, c: str) -> list[int]:
        t = self.alone.get(c)
        return [t] if t is not None else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def _direct(self, seg: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.merge(seg):
            t = self.ids.get(p)
            ids.extend([t] if t is not None else [x for c in p for x in self._lone(c)])
        return tuple(ids)

    def encode(self, texts: list[str], run_chars: int = CHUNK_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids; new
        segments are indexed in runs of about ``run_chars`` characters."""
        number, kept = self._number, len(self._size)
        try:
            per_text, flat = [], []
            for t in texts:
                segs = self.segment.findall((BLANK + t).replace(" ", BLANK)) if t else []
                per_text.append(len(segs))
                flat.extend(segs)
            codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            del flat
            new = list(islice(reversed(number), len(number) - kept))[::-1]
            several = np.fromiter((s.startswith(BLANK * 2) for s in new), bool, len(new))
            direct = [self._direct(new[i]) for i in np.flatnonzero(several).tolist()]
            ids, sizes = [self._ids], []
            for run in _runs([s for s in new if not s.startswith(BLANK * 2)] if direct else new, run_chars):
                for got, to in zip(self.encode_segments(run), (ids, sizes)):
                    to.append(got)
                if len(self._pair) > PAIRS:
                    self._pair.clear()
            ids.append(np.array([i for x in direct for i in x], dtype=np.int32))
            sizes.append(np.fromiter(map(len, direct), np.int64, len(direct)))
            ids, made = np.concatenate(ids), np.concatenate(sizes)
            size = np.empty(len(new), np.int64)
            first = np.empty(len(new), np.int64)
            place = np.argsort(several, kind="stable")
            size[place], first[place] = made, np.cumsum(made) - made + len(self._ids)
            size, first = np.concatenate((self._size, size)), np.concatenate((self._first, first))
            if kept < CACHE_SEGMENTS:
                self._first, self._size, self._ids = first, size, ids
        finally:
            while len(number) > len(self._size):  # not kept
                number.popitem()
        n = size[codes]
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.concatenate(([0], np.cumsum(per_text))).astype(np.int64)
        return ids[_spans(first[codes], n)], total[at[1:]] - total[at[:-1]]

    def decode(self, ids) -> str:
        raw = self.raw
        s = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return s[1:] if s[:1] == " " else s


def _runs(segs: list[str], run_chars: int) -> Iterator[list[str]]:
    """Segments in runs of about ``run_chars`` characters: the index of a run
    takes some hundred bytes a character.  A segment is never divided."""
    run, size = [], 0
    for s in segs:
        run.append(s)
        size += len(s) + 1
        if size >= run_chars:
            yield run
            run, size = [], 0
    if run:
        yield run


_MODELS: dict[int, Model] = {}


def _model(bc) -> Model:
    """The broadcast vocabulary's tables, kept by the worker between tasks."""
    value = bc.value
    key = hash((len(value[0]), tuple(value[0][-50:]), tuple(value[1][-50:])))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*value)
    return _MODELS[key]


def _chunks(col: pa.Array, chunk_chars: int) -> Iterator[tuple[int, int, list[str]]]:
    texts, start, size = [], 0, 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= chunk_chars:
            yield start, i + 1, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, len(col), texts


def encode(df: DataFrame, text: str = "text", out: str = "ids", model_path: str = DEFAULT_MODEL,
           keep_text: bool = True) -> DataFrame:
    """Add ``out array<int>``: the ids of ``text``."""
    return _with_ids(df, text, out, None, model_path, keep_text)


def encode_checked(df: DataFrame, text: str = "text", out: str = "ids", check: str = "round_trip",
                   model_path: str = DEFAULT_MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode and decode again: adds the ids and whether they read back as
    the text; the text itself is not passed on.  Smaller ``chunk_chars`` need
    less memory."""
    return _with_ids(df, text, out, check, model_path, False, chunk_chars)


def _with_ids(df: DataFrame, text: str, out: str, check: str | None, model_path: str, keep_text: bool,
              chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    run_chars = chunk_chars if chunk_chars >= CHUNK_CHARS else int(chunk_chars * RUN_SHARE)
    bc = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = [c for c in df.columns if keep_text or c != text]
    added = [T.StructField(out, T.ArrayType(T.IntegerType(), False))] + (
        [T.StructField(check, T.BooleanType())] if check else [])
    schema = T.StructType([df.schema[c] for c in names] + added)
    at = df.columns.index(text)
    pick = [i for i, c in enumerate(df.columns) if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(bc)
        for b in batches:
            for lo, hi, texts in _chunks(b.column(at), chunk_chars):
                ids, sizes = m.encode(texts, run_chars)
                offs = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                cols = [b.column(i).slice(lo, hi - lo) for i in pick]
                cols.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(ids, pa.int32())))
                if check:
                    flat = ids.tolist()
                    cols.append(pa.array([m.decode(flat[offs[k]:offs[k + 1]]) == t for k, t in enumerate(texts)]))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, out, *([check] if check else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Add ``out string``: the text that ``ids`` stand for (NULL ids: '')."""
    bc = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    at, names = df.columns.index(ids), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(bc)
        for b in batches:
            texts = [m.decode(x.as_py() or ()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op6_sentencepiece(docs: DataFrame) -> DataFrame:
    """Per document: its ids, their number, whether they decode to the text."""
    return encode_checked(docs.select("doc_id", "text")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
