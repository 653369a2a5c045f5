"""Order-preserving packing of tokenised documents into sequences by dynamic programming.

Each partition of the input is one stream: its documents' ids one after another,
in the order of the rows. Windows of at most `length` ids are cut from it. A cut
may stand at the end of a document (free), at the end of a sentence (a small
penalty) or, inside sentences of over `gap` ids, at fixed steps (a larger one).
A window costs its padding up to `length`, or nothing if its size is a power of
two, which is kept unpadded. The cuts of least total cost come from

    best[i] = penalty[i] + min over j of best[j] + cost(pos[i] - pos[j])

where padding is (length - pos[i]) + (best[j] + pos[j]): a sliding-window
minimum that a monotone queue gives in amortised constant time. The unpadded
windows are one look-up for each power of two.

Streams are handled in chunks of `chunk` ids so that a task holds a bounded
number of ids; the last window of a chunk is carried into the next.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import released

WORDS = re.compile(r"[^ \t-\r]+").findall
#: Cost of a cut within a document, in ids of padding.
SENTENCE_CUT, HARD_CUT = 2.0, 24.0
#: A window of any size costs a little, so that streams are not cut into many short ones.
WINDOW = 8.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_CLOSING = ".,!?*$%&#|;:"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each Latin letter: printable bytes stand for themselves, the others for U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(0x100) if x not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x250)}


#: Texts on which a tokenizer shows whether it works word by word as `WordIds` takes it to.
_TRIAL = (
    "The Quick brown FOX, jumped over 12.5% of it's lazy dogs!! (What?) \"Yes.\" e.g. a-b_c x=1; #tag $5 & |pipe| 'S don't... end.",
    "Ünïcode naïve ÉCOLE straße ŒUVRE ĳ café, déjà-vu. ¿Qué? «Oui»\n\tLine two:  tabs\tand   spaces\r\nABC123abc", "日本語 текст Ἀθήνα ½ ² ﬁne x\u00a0y 12345678901234567890 " + "longword" * 8,
)


class WordIds(dict):
    """Ids (little-endian bytes) of words, worked out when first asked for.

    A tokenizer that drops white space, lower-cases, and sets letters apart from
    other characters, byte-level, lets closing punctuation be set apart from a
    letter before it, and takes a word of Latin letters as one piece for the
    model. Other words go through the whole tokenizer. Where a tokenizer gives
    other ids on trial texts than these, whole texts go through it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        ends = [self.tok.token_to_id(x + "</w>") for x in (".", "!", "?", ".\"", "!\"", "?\"", ".)", "...", "!!", "??", "?!")]
        self.sentence_end = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.sentence_end[[x for x in ends if x is not None]] = True
        self.by_word = True
        whole = [self.tok.encode(t, add_special_tokens=False).ids for t in _TRIAL]
        self.by_word = all(self.encode(t, b"").tolist() == ids for t, ids in zip(_TRIAL, whole, strict=True))

    @staticmethod
    def of_worker(path: str, keep: int) -> WordIds:
        """The words that earlier tasks of this Python worker have met, cleared beyond `keep` of them."""
        store = sys.modules.setdefault("lodestone_worker_store", ModuleType("lodestone_worker_store"))
        made = store.__dict__.setdefault("word_ids", {})
        if path not in made:
            made[path] = WordIds(path)
        if len(made[path]) > keep:
            made[path].clear()
        return made[path]


    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(_CLOSING)
        low = body.lower()
        if body and len(low) == len(body) and low.isalpha() and max(low) < "\u0250":
            if body is not word:
                value = self[low] + self[word[len(body) :]]
            elif low != word:
                value = self[low]
            else:
                text = low if low.isascii() else low.translate(self.letters)
                value = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        else:
            value = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = value
        return value

    def encode(self, text: str | None, end: bytes) -> np.ndarray:
        """Ids of a text, `end` appended; null is empty."""
        if text and not self.by_word:
            return np.frombuffer(array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes() + end, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, WORDS(text))) + end if text else end, "<u4")


def cut_points(ids: np.ndarray, starts: np.ndarray, sentence_end: np.ndarray, gap: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 and its end among them, and their penalties. starts: first id of each document."""
    n = len(ids)
    pen = np.full(n + 1, np.inf)
    sent = np.flatnonzero(sentence_end[ids]) + 1
    pen[sent] = SENTENCE_CUT
    pen[starts] = 0.0
    pen[0] = pen[n] = 0.0
    pos = np.flatnonzero(np.isfinite(pen))
    long = np.flatnonzero(np.diff(pos) > gap)
    if len(long):
        extra = np.concatenate([np.arange(pos[k] + step, pos[k + 1], step) for k in long])
        pen[extra] = HARD_CUT
        pos = np.flatnonzero(np.isfinite(pen))
    return pos, pen[pos]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Indices into pos of the cuts of least cost, first and last among them."""
    p, pen = pos.tolist(), penalty.tolist()
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque = deque([(0.0, 0)])  # (best[j] + pos[j], j), least first
    for i in range(1, len(p)):
        at = p[i]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        low, j = queue[0]
        low += length - at
        for w in powers:
            k = index.get(at - w)
            if k is not None and best[k] < low:
                low, j = best[k], k
        low += pen[i] + WINDOW
        best[i], back[i] = low, j
        low += at
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, i))
    cuts, i = [], len(p) - 1
    while i:
        cuts.append(i)
        i = back[i]
    return [0, *reversed(cuts)]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 20, gap: int = 128, step: int = 32, keep_words: int = 400_000, with_ids: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids.

    Every document has its ids and `end`; each id lies in exactly one piece, and
    the pieces of a sequence follow each other without a gap. A sequence of n
    ids is padded to `length` unless n is a power of two. Null and empty texts
    are documents of the one id `end`; equal rows and null ids are packed as
    documents of their own; very long texts run over many sequences. An empty
    table gives an empty result; other columns of the input, whatever their
    names, play no part. Sequence numbers are the partition's number
    times 2^40 and a count, and cuts follow the order of a partition's rows, so
    a rerun over the same files agrees and a lost task is repeated alone; no
    rows are moved. `order` names columns by which the rows of each partition
    are sorted first, for inputs whose order is not fixed, as after a shuffle.

    chunk: ids worked on at once. Beyond it the last four windows' worth of ids
    are cut again with what follows, at every size of the input alike.

    tokenizer: path of a vocabulary file in tokenizers' format, one that drops
    white space. It must be readable on the executors.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tail = int(end).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, start, doc_tokens, ids): pieces not yet in a sequence
        count = 0

        def settle(final: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, count, sequence
            if not held:
                return
            ids = np.concatenate([h[3] for h in held])
            sizes = np.array([len(h[3]) for h in held])
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            free = firsts[:-1][np.array([h[1] == 0 for h in held])]
            pos, penalty = cut_points(ids, free, WordIds.of_worker(tokenizer, keep_words).sentence_end, gap, step)
            cuts = pos[best_cuts(pos, penalty, length)].tolist()
            if not final:
                # the chunk's end is no end of the stream: its last windows are cut again with what follows
                while len(cuts) > 2 and cuts[-1] > len(ids) - 4 * length:
                    cuts.pop()
            rows, d = [], 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                d = bisect_left(firsts, a + 1, d) - 1
                x = a
                while x < b:
                    doc, start, total, own = held[d]
                    y = min(b, int(firsts[d + 1]))
                    part = own[x - int(firsts[d]) : y - int(firsts[d])]
                    rows.append((doc, start + x - int(firsts[d]), y - x, zlib.crc32(part.tobytes()), total, sequence, x - a, *([part.astype("int32")] if with_ids else [])))
                    x, d = y, d + (y == firsts[d + 1])
                sequence += 1
                d = min(d, len(held) - 1)
            last = cuts[-1]
            rest = []
            for k in range(bisect_left(firsts, last + 1) - 1, len(held)):
                doc, start, total, own = held[k]
                off = max(0, last - int(firsts[k]))
                rest.append((doc, start + off, total, own[off:].copy()))
            held = [] if last == len(ids) else rest
            count = sum(len(h[3]) for h in held)
            out = pd.DataFrame(rows, columns=columns + (["ids"] if with_ids else []))
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

        for pdf in batches:
            tok = WordIds.of_worker(tokenizer, keep_words)
            for name, text in zip(pdf["id"], pdf["text"], strict=True):
                doc, ids = None if pd.isna(name) else int(name), tok.encode(text if isinstance(text, str) else None, tail)
                for s in range(0, len(ids), chunk):
                    held.append((doc, s, len(ids), ids[s : s + chunk]))
                    count += len(held[-1][3])
                    if count >= chunk:
                        yield from settle(False)
        yield from settle(True)
        pdf = None
        released()

    narrow = (docs.sortWithinPartitions(*order) if order else docs).selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text")
    return narrow.mapInPandas(run, schema)
