"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from chorale.llm.common import built, map_rows

SPACE = "▁"
#: Longer words and segments are not remembered, so that a memory of n entries has a bound in bytes.
LONGEST_KEPT = 64


class PieceCoder:
    """Encodes with an agenda of adjacent symbol pairs, best score first, leftmost among equals.

    A pair joins where the vocabulary has the joined piece. Two characters that stand side by side
    in no piece can never join, so a text falls into independent segments there; a segment's result
    is kept, in a memory of at most ``max_chunks`` entries, and so is a word's. Each new word is
    compared with the library's result before it is used.
    """

    def __init__(self, path: str, max_chunks: int):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_chunks = max_chunks
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: k for k, i in enumerate(sorted(plain, key=lambda i: (-lib.get_score(i), i)))}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = lib.unk_id()
        self.by_rank = np.array([i for _, i in sorted((r, self.ids[p]) for p, r in self.rank.items())], dtype=np.int64)
        pairs = {(self.ids[p[:k]] << 32 | self.ids[p[k:]]): r for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.beside = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.segments: dict[str, list[int]] = {}
        self.words: dict[str, tuple[str, bytes]] = {}
        self.passing: list[str] = []  # long words, forgotten after the texts at hand

    def _merge(self, text: str) -> list[int]:
        rank = self.rank.get
        symbol = list(text)
        n = len(symbol)
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] + symbol[i + 1])) is not None]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            best = heappop(agenda)
            i = best & 0xFFFFFFFF
            left, j = symbol[i], after[i]
            if not left or j >= n or rank(left + symbol[j]) != best >> 32:
                continue
            symbol[i], symbol[j] = left + symbol[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbol[i] + symbol[k])) is not None:
                    heappush(agenda, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbol[h] + symbol[i])) is not None:
                heappush(agenda, r << 32 | h)
        out: list[int] = []
        for s in symbol:
            if s:
                out.extend([self.ids[s]] if s in self.ids else self._fallback(s))
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _encode(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already marks."""
        out: list[int] = []
        beside, start = self.beside, 0
        for end in range(1, len(text) + 1):
            if end == len(text) or text[end - 1 : end + 1] not in beside:
                segment = text[start:end]
                ids = self.segments.get(segment)
                if ids is None:
                    if len(self.segments) >= self.max_chunks:
                        self.segments.clear()
                    ids = self._merge(segment)
                    if len(segment) <= LONGEST_KEPT:
                        self.segments[segment] = ids
                out.extend(ids)
                start = end
        return out

    def encode(self, text: str) -> list[int]:
        return self._encode(SPACE + text.replace(" ", SPACE)) if text else []

    def _decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces; bytes that form no character become the replacement character."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out).encode()

    def decode(self, ids: list[int]) -> str:
        return self._decode(ids).decode().removeprefix(" ")

    def _merge_many(self, words: list[str]) -> dict[str, list[int]]:
        """The agenda for many short words at once: a row for each word, and in each round every
        row joins its best pair. Words with characters outside the vocabulary are left out."""
        out: dict[str, list[int]] = {}
        words = [w for w in words if len(w) <= LONGEST]
        for least, most in ((1, 8), (9, 16), (17, LONGEST)):
            some = [w for w in words if least <= len(w) <= most]
            if not some:
                continue
            n, lengths = len(some), np.fromiter(map(len, some), dtype=np.int64)
            points, where = np.unique(np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4"), return_inverse=True)
            ids = np.array([self.ids.get(chr(c), UNKNOWN) for c in points.tolist()], dtype=np.int64)[where]
            grid = np.full((n, most), NOTHING, dtype=np.int64)
            grid[np.arange(most) < lengths[:, None]] = ids
            rows = np.flatnonzero(~(grid == UNKNOWN).any(1))
            grid = grid[rows]
            ranks = self._pair_rank(grid[:, :-1], grid[:, 1:])
            columns = np.arange(most)
            while len(rows):
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                over = best == NO_PAIR
                if over.any():
                    for r, ids in zip(rows[over].tolist(), grid[over].tolist()):
                        out[some[r]] = ids[: ids.index(NOTHING)] if NOTHING in ids else ids
                    rows, grid, ranks, at, best = rows[~over], grid[~over], ranks[~over], at[~over], best[~over]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                grid[:, :-1] = np.where(columns[:-1] > at[:, None], grid[:, 1:], grid[:, :-1])
                grid[:, -1] = NOTHING
                grid[line, at] = self.by_rank[best]
                ranks[:, :-1] = np.where(columns[:-2] > at[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NO_PAIR
                right = at < most - 1
                ranks[line[right], at[right]] = self._pair_rank(grid[line[right], at[right]], grid[line[right], at[right] + 1])
                left = at > 0
                ranks[line[left], at[left] - 1] = self._pair_rank(grid[line[left], at[left] - 1], grid[line[left], at[left]])
        return out

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_PAIR)

    def _learn(self, words: list[str]) -> None:
        """Encode and decode new words, and compare them with the library. What stands before a
        word joins no mark, so the library gets a line break first."""
        many = self._merge_many(words)
        lead = self.lib.encode("\n")
        shown, raw, of_byte, skip = self.decimal, self.raw, self.of_byte, len(lead)
        for word, theirs in zip(words, self.lib.encode(["\n" + w for w in words], num_threads=1)):
            ids = many.get(word)
            if ids is None:
                ids = self._encode(word)
            if ids != theirs[skip:]:
                raise RuntimeError(f"ids of {word!r} differ from the library's")
            decoded = self._decode(ids) if any(i in of_byte for i in ids) else b"".join([raw[i] for i in ids])
            self.words[word] = ",".join([shown[i] for i in ids]), decoded
            if len(word) > LONGEST_KEPT:
                self.passing.append(word)

    def _chunks(self, text: str) -> list[str]:
        """Words with the marks before them; line breaks by themselves, as no piece holds one."""
        chunks: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                chunks.append("\n")
            if SPACE in line or "  " in line or line[-1:] == " " or line[:1] == " ":
                chunks.extend(WORD.findall(("" if k else SPACE) + line.replace(" ", SPACE)))
            else:
                first, *rest = line.split(" ")
                if not k:
                    chunks.append(SPACE + first)
                elif first:
                    chunks.append(first)
                chunks.extend([SPACE + w for w in rest])
        return chunks

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids' decimals, SHA-256 of the decoded text."""
        if any("\n" in p for p in self.beside) or "\n" in self.ids:
            raise ValueError("vocabularies with line breaks inside pieces are not supported")
        start = 0
        while start < len(texts):
            end, size, lists = start, 0, []
            while end < len(texts) and size < 4_000_000:
                lists.append(self._chunks(texts[end]) if texts[end] else [])
                size += len(texts[end])
                end += 1
            start = end
            if len(self.words) > self.max_chunks:
                self.words.clear()
            known = self.words.get
            rows = [list(map(known, chunks)) for chunks in lists]
            short = [k for k, found in enumerate(rows) if None in found]
            self._learn(list({c for k in short for c, f in zip(lists[k], rows[k]) if f is None}))
            for k in short:
                rows[k] = list(map(known, lists[k]))
            for word in self.passing:
                del self.words[word]
            self.passing.clear()
            for found in rows:
                ids = ",".join([a for a, _ in found])
                decoded = b"".join([b for _, b in found]).removeprefix(b" ")
                yield ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


LONGEST, UNKNOWN, NOTHING, NO_PAIR = 32, -2, -1, 1 << 40
WORD = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def coder(path: str, max_chunks: int) -> PieceCoder:
    return built((path, max_chunks, "pieces"), lambda: PieceCoder(path, max_chunks))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = 600_000) -> DataFrame:
    """Id and ``ids array<int>`` of each whole text (null: empty), as the sentencepiece library gives them."""

    def run(keys, texts) -> Iterator[tuple]:
        c = coder(model, max_chunks)
        for key, text in zip(keys, texts):
            yield key, c.encode(text or "")

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>", run)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", max_chunks: int = 600_000) -> DataFrame:
    """Id and text of each row's ``ids`` (null: empty)."""

    def run(keys, ids) -> Iterator[tuple]:
        c = coder(model, max_chunks)
        for key, row in zip(keys, ids):
            yield key, c.decode(row or [])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded, [id_col, "ids"], f"`{id_col}` {kind}, text string", run)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = 600_000) -> DataFrame:
    """Encode and decode each whole text: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. Repeated rows are coded one by one; an empty table gives an
    empty result; other columns are not read. Each new word is checked against the library, and of
    each Arrow batch the first text as a whole.
    """

    def run(keys, texts) -> Iterator[tuple]:
        gc.disable()  # the memory of words holds no cycles, and walking it costs as much as filling it
        c = coder(model, max_chunks)
        if texts:
            first = texts[0] or ""
            ids = c.lib.encode(first)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), c.lib.decode(ids))]
            if next(c.digests([first])) != (len(ids), *sha):
                raise RuntimeError("ids or decoded text differ from the library's")
        for key, found in zip(keys, c.digests([t or "" for t in texts])):
            yield key, *found

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run, slice_rows=10_000)
