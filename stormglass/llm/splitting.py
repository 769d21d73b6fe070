"""Splitting oversized items at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, load

#: Strength of a boundary: the end of a paragraph, line, sentence or word, or between any two tokens.
PARAGRAPH, LINE, SENTENCE, WORD, TOKEN = 4, 3, 2, 1, 0
BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
ENDS = re.compile(rf"(?P<p>{BREAK}[^\S\n\r\x0b\x0c\x85\u2028\u2029]*{BREAK}\s*)|(?P<l>{BREAK})|(?P<s>[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[”’」』）]*)")
GAP = re.compile(r"\s+")


def _bytes_at(text: str) -> np.ndarray | None:
    """Byte offset of each character, or None if they are the same."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]


def _boundaries(text: str, starts: np.ndarray, words: bool) -> dict[int, int]:
    """Token positions at which the text may be cut, with the strength of each."""
    at, kind = [], []
    for m in ENDS.finditer(text):
        at.append(m.end())
        kind.append(PARAGRAPH if m["p"] else LINE if m["l"] else SENTENCE)
    if words:
        for m in GAP.finditer(text):
            at.append(m.start())
            kind.append(WORD)
    where = np.array(at, np.int64)
    if (own := _bytes_at(text)) is not None:
        where = own[where]
    token = np.searchsorted(starts, where, side="right") - 1
    out: dict[int, int] = {}
    for t, k in zip(token.tolist(), kind):
        if 0 < t < len(starts) - 1 and k > out.get(t, 0):
            out[t] = k
    return out


def merge(bounds: list[int], strength: list[int], most: int) -> list[int]:
    """Merges adjacent segments and returns the bounds that stay.

    ``bounds`` are the n + 1 ends of n segments, ``strength`` those of the n - 1
    boundaries within. The pair with the weakest boundary is merged first, of
    equal ones that with the smallest result and then the leftmost, as long as
    the result has at most ``most`` tokens.
    """
    n = len(bounds) - 1
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    start, end = bounds[:-1], bounds[1:]
    gone = [False] * n
    heap = [(strength[i], end[i + 1] - start[i], start[i], i, i + 1) for i in range(n - 1) if end[i + 1] - start[i] <= most]
    heapq.heapify(heap)
    after = [*strength, 0]
    while heap:
        _, size, _, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or end[j] - start[i] != size:
            continue
        end[i], right[i], after[i], gone[j] = end[j], right[j], after[j], True
        if right[i] >= 0:
            left[right[i]] = i
            if end[right[i]] - start[i] <= most:
                heapq.heappush(heap, (after[i], end[right[i]] - start[i], start[i], i, right[i]))
        if left[i] >= 0 and end[i] - start[left[i]] <= most:
            heapq.heappush(heap, (after[left[i]], end[i] - start[left[i]], start[left[i]], left[i], i))
    return [*(start[i] for i in range(n) if not gone[i]), bounds[-1]]


def _char_starts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Which tokens begin with the first byte of a character."""
    return (np.frombuffer(data, np.uint8)[starts[:-1]] & 0xC0) != 0x80


def pieces(text: str, limit: int, overlap: int, tokenizer: str = TOKENIZER) -> list[tuple[int, int, int, str]]:
    """``(first token, first own token, end token, text)`` of each piece of one
    text; none if it fits the limit."""
    encoding, size = load(tokenizer)
    tokens = encoding.encode_ordinary(text)
    if len(tokens) <= limit:
        return []
    data = text.encode("utf-8", "surrogatepass")
    starts = np.r_[0, np.cumsum(size[tokens])]
    whole = _char_starts(data, starts)
    # A cut within a character moves the overlap back by up to 3 tokens.
    most = limit - overlap - (0 if len(data) == len(text) else 3)
    cuts = _boundaries(text, starts, False)
    bounds = [0, *sorted(t for t in cuts if whole[t]), len(tokens)]
    if max(np.diff(bounds)) > most:
        words = _boundaries(text, starts, True)
        full = [bounds[0]]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > most:
                inner = sorted(t for t in words if a < t < b and whole[t]) if b - a < 5_000 else None
                if inner is None:
                    keys = np.array(sorted(words), np.int64)
                    inner = [t for t in keys[(keys > a) & (keys < b)].tolist() if whole[t]]
                for c, d in zip([a, *inner], [*inner, b]):
                    while d - c > most:
                        step = c + most
                        while step > c + 1 and not whole[step]:
                            step -= 1
                        full.append(step)
                        c = step
                    full.append(d)
            else:
                full.append(b)
        cuts, bounds = words, full
    kept = merge(bounds, [cuts.get(t, TOKEN) for t in bounds[1:-1]], most)
    out = []
    for i, (a, b) in enumerate(zip(kept, kept[1:])):
        first = a - overlap if i else a
        while first > 0 and not whole[first]:
            first -= 1
        part = data[starts[first] : starts[b]].decode("utf-8", "surrogatepass")
        while first < a and len(encoding.encode_ordinary(part)) > limit:
            # Alone, the torn word at the start can need more tokens than within its text.
            first += 1
            while first < a and not whole[first]:
                first += 1
            part = data[starts[first] : starts[b]].decode("utf-8", "surrogatepass")
        out.append((first, a, b, part))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int, tokenizer: str = TOKENIZER, with_text: bool = True) -> DataFrame:
    """``key, piece_no, n_pieces, token_from, token_to, n_shared[, text]`` of the
    items whose text has more than ``limit`` tokens; others give no rows.

    Pieces have at most ``limit`` tokens. Each after the first begins with the
    last ``overlap`` tokens of the text before it (``n_shared``: up to 3 more
    where the cut would fall within a character, fewer only where the torn start
    alone would need more tokens than the limit allows). Without the shared
    tokens the pieces, in order, are the text. Cuts are at the strongest
    boundaries the sizes allow; a text without any is cut between tokens.

    Null and empty texts fit any limit. Rows are handled on their own, so
    repeated keys give repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit - 3:
        raise ValueError("the overlap must be at least 4 tokens below the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            chars = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pieces(t, limit, overlap, tokenizer)
                for i, (first, own, end, part) in enumerate(found):
                    rows.append((k, i + 1, len(found), first, end, own - first, part if with_text else None))
                chars += len(t) * with_text
                if chars > 8_000_000:
                    yield take(rows)
                    rows, chars = [], 0
            if rows:
                yield take(rows)

    def take(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if kind == "bigint" else None, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[key, "piece_no", "n_pieces", "token_from", "token_to", "n_shared", "text"])

    kind = df.schema[key].dataType.simpleString()
    # A token has at least one byte: shorter texts fit without being tokenized.
    large = df.where(F.octet_length(text) > limit).select(key, text)
    out = large.mapInArrow(run, f"`{key}` {kind}, piece_no int, n_pieces int, token_from bigint, token_to bigint, n_shared int, text string")
    return out if with_text else out.drop("text")
