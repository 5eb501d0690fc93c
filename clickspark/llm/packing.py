"""Order-preserving packing of documents into token windows.

Documents of a partition form one token stream in their order.  Window cuts
are chosen by dynamic programming over candidate cuts: document ends (free),
sentence ends (``SENTENCE`` tokens of penalty) and, where a stretch has
neither, every ``GRID`` tokens (``FORCED``).  With ``dp[i]`` the least cost
of packing the stream up to candidate ``i`` at position ``c_i``

    dp[j] = penalty_j + window - c_j + min { dp[i] + c_i : c_j - c_i <= window }

so the inner minimum is a sliding-window minimum: a monotone queue gives each
transition in amortised constant time.  The stream is cut ``HORIZON`` tokens
at a time, carrying the unfinished last window on, so memory is bounded
whatever the partition holds; the tail of a partition is cut into windows of
power-of-two length, which need no padding.

No shuffle: every partition of the scan packs its own documents, and window
numbers are (partition, counter).  Null texts are empty: such a document is
its end id alone.  Very long texts spread over many windows; ties between
cuts go to the earliest; repeated rows are packed again; null doc_ids stay
null; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import map_rows, table

#: Contract values: window, the id that ends a document, the tokenizer file.
WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Cut penalties in tokens of padding, the grid of forced cuts, the stretch
#: of tokens that is optimised at a time.
SENTENCE, FORCED, GRID, HORIZON = 8, 48, 64, 1 << 18

#: Characters of texts encoded at a time; new parts in one string, the part
#: that stands between them (a pre-token of its own, one id).
GROUP, JOINED, BETWEEN = 1 << 20, 48, "\x01"


class WordTokenizer:
    """Token ids of whole texts as little-endian ``uint32`` bytes.

    The tokenizer drops white space and never joins across it, so a text's
    ids are those of its space-separated parts, which are kept in a table
    of at most ``limit`` parts (cleared when full).  The parts that a group of
    texts adds are encoded together, many in one string, and cut apart again:
    words of letters, which are one pre-token each, after their word-end piece,
    others at the id that stands between them."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.limit, self.ids = limit, {"": b""}
        vocab = self.tok.get_vocab()
        self.sentence_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end = np.zeros(len(self.sentence_end), bool)
        for piece, i in vocab.items():
            self.word_end[i] = piece.endswith("</w>")
            word = piece.removesuffix("</w>")
            self.sentence_end[i] = bool(word) and set(word) <= set(".!?") and piece.endswith("</w>")
        between = self._encode([BETWEEN])[0]
        self.between = int(between[0]) if len(between) == 1 else None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts) -> None:
        words, signs, alone = [], [], []
        for p in parts:
            (words if p.isalpha() else alone if self.between is None or BETWEEN in p else signs).append(p)
        for some, glue in ((words, " "), (signs, f" {BETWEEN} ")):
            groups = [some[i:i + JOINED] for i in range(0, len(some), JOINED)]
            for group, ids in zip(groups, self._encode([glue.join(g) for g in groups])):
                if some is words:
                    stops = (np.flatnonzero(self.word_end[ids]) * 4 + 4).tolist()
                    starts = [0, *stops[:-1]]
                else:
                    cuts = (np.flatnonzero(ids == self.between) * 4).tolist()
                    starts, stops = [0, *[c + 4 for c in cuts]], [*cuts, 4 * len(ids)]
                if len(stops) != len(group):  # the joining cannot be undone: one by one
                    alone += group
                    continue
                data = ids.tobytes()
                self.ids.update(zip(group, [data[a:b] for a, b in zip(starts, stops)]))
        self.ids.update((p, i.tobytes()) for p, i in zip(alone, self._encode(alone)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.ids) > self.limit:
            self.ids = {"": b""}
        ids = self.ids
        new = {p for parts in split for p in parts if p not in ids}
        if new:
            self._learn(new)
        get = ids.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def grouped(rows: Iterator[tuple], size: int = GROUP) -> Iterator[list[tuple]]:
    """(key, text) rows in groups of about ``size`` characters."""
    group, n = [], 0
    for key, text in rows:
        group.append((key, text or ""))
        n += len(group[-1][1])
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer for a file, loaded once."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in (0, len(ids)] and their penalties; ``ends`` are the
    positions after each document's last id."""
    n = len(ids)
    stops = np.flatnonzero(sentence_end[ids]) + 1
    at = np.union1d(np.union1d(stops, ends), [n])
    grid = min(GRID, window)
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    forced = np.concatenate([np.arange(at[k] - gaps[k] + grid, at[k], grid) for k in wide] or [np.zeros(0, np.int64)])
    at = np.union1d(at, forced)
    penalty = np.full(len(at), SENTENCE)
    penalty[np.isin(at, forced)] = FORCED
    penalty[np.isin(at, ends)] = 0
    return at, penalty


def best_cuts(at: list[int], penalty: list[int], window: int) -> tuple[list[float], list[int]]:
    """dp cost and predecessor (-1: the start) for every candidate."""
    cost, prev = [], []
    keys, where, pos = [0], [-1], [0]  # queue: dp + c, candidate, c; keys increase
    head = 0
    for j, c in enumerate(at):
        low = c - window
        while pos[head] < low:
            head += 1
        d = penalty[j] + window - c + keys[head]
        cost.append(d)
        prev.append(where[head])
        key = d + c
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            where.pop()
            pos.pop()
        keys.append(key)
        where.append(j)
        pos.append(c)
    return cost, prev


def window_ends(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int, last: bool) -> list[int]:
    """Ends of the windows to commit.  Not ``last``: up to the best cut among
    those in the final window's reach.  ``last``: everything, the remainder
    in power-of-two windows."""
    n = len(ids)
    at, penalty = candidates(ids, ends, sentence_end, window)
    at_l = at.tolist()
    cost, prev = best_cuts(at_l, penalty.tolist(), window)
    first = int(np.searchsorted(at, max(0, n - window), "left"))
    options = range(first, len(at_l) - 1)
    # the remainder after the chosen cut costs nothing but a cut per window of it
    rest = lambda j: SENTENCE * (n - at_l[j]).bit_count() if last else 0
    j = min(options, key=lambda j: (cost[j] + rest(j), j), default=-1)
    if n <= window and (last or j < 0 or cost[j] > 0):
        whole = SENTENCE * (n.bit_count() - 1)
        j = -1 if j < 0 or not last or whole <= cost[j] + rest(j) else j
    cuts = []
    k = j
    while k >= 0:
        cuts.append(at_l[k])
        k = prev[k]
    cuts.reverse()
    if last:
        done = cuts[-1] if cuts else 0
        while done < n:
            done += min(window, 1 << ((n - done).bit_length() - 1))
            cuts.append(done)
    return cuts


def pack_stream(docs: Iterator[tuple[int | None, bytes]], sentence_end: np.ndarray, first_window: int,
                window: int = WINDOW, end_id: int = END_ID, horizon: int = HORIZON) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, crc32, doc_tokens, window number,
    offset) of a stream of (doc_id, ids without the end id)."""
    horizon = max(horizon, 4 * window)
    end = np.array([end_id], "<u4").tobytes()
    number = first_window
    held: list[list] = []  # doc_id, its tokens, its ids already placed, its remaining ids
    size = 0

    def flush(last: bool):
        nonlocal held, size, number
        data = b"".join(h[3] for h in held)
        ids = np.frombuffer(data, "<u4")
        ends = np.cumsum([len(h[3]) // 4 for h in held])
        cuts = window_ends(ids, ends, sentence_end, window, last)
        k, at = 0, 0  # document and stream position
        for stop in cuts:
            begin = at
            while at < stop:
                h = held[k]
                until = min(stop, int(ends[k]))
                yield (h[0], h[2], until - at, zlib.crc32(data[4 * at:4 * until]), h[1], number, at - begin)
                h[2] += until - at
                at = until
                if at == ends[k]:
                    k += 1
            number += 1
        held = held[k:]
        if held:
            held[0][3] = data[4 * at:4 * int(ends[k])]
        size = sum(len(h[3]) for h in held) // 4

    for doc_id, ids in docs:
        ids += end
        held.append([doc_id, len(ids) // 4, 0, ids])
        size += len(ids) // 4
        if size >= horizon:
            yield from flush(False)
    if held:
        yield from flush(True)


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece (columns of the contract), in order by sequence_id
    and offset within a partition."""

    def run(batches):
        tok = tokenizer(tokenizer_path)
        rows_in = ((d, t) for b in batches for d, t in zip(b["doc_id"], b["text"]))
        stream = ((d, ids) for g in grouped(rows_in) for (d, _), ids in zip(g, tok.encode_all([t for _, t in g])))
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for piece in pack_stream(stream, tok.sentence_end, first, window, end_id):
            rows.append(piece)
            if len(rows) >= 4096:
                yield dict(zip(_COLUMNS, zip(*rows)))
                rows = []
        if rows:
            yield dict(zip(_COLUMNS, zip(*rows)))

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, ", ".join(f"`{c}` long" for c in _COLUMNS))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: contract columns over all documents."""
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of every document that is left."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path(TOKENIZER))
