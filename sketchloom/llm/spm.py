"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut where no piece can cross (before a run of word separators, and inside long
words where no piece holds the two characters that meet).  The distinct words of a block
are grouped by length; words of one length advance together: at each end, substring
hashes of all starts probe the sorted piece keys, and a vectorised maximum stores the
backpointers.

For unigram models the maximum is over path scores.  For BPE models, whose encoding is
not the path of the best score sum, a step is admissible only if the model's merges keep
its piece and the piece before it apart; exactly one step into each end is, so the maximum
is over a set of one and the path is the model's own encoding.

Defined cases: a null or empty text has no pieces and decodes to the empty text; characters
outside the vocabulary become byte pieces (or the unknown piece if the model has none); a text
without separators takes one numpy step for each character between two cuts;
repeated rows are encoded alike; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .pieces import _TOP, BYTE, DEFAULT_MODEL, NORMAL, SPACE, UNKNOWN, Model, PieceIndex, by_length, codes, prefix_hashes

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_STRANGE = -1  # a character outside the vocabulary
_LONG = 48
_SLOTS = 20
_MIX = np.int64(-7046029254386353131)


class Codec:
    """Encoder and decoder of one model.

    Words are remembered in two generations of about ``cache_bytes`` each; words that come up
    again move to the newer one, the older one is forgotten when that is full.
    """

    def __init__(self, path: str = DEFAULT_MODEL, cache_bytes: int = 48_000_000):
        self.model = m = Model.load(path)
        self.cache_bytes = cache_bytes
        self.release()
        own = [k for k, kind in enumerate(m.kinds) if kind == NORMAL]
        if m.is_bpe:  # numbers: single characters, then merges in their order
            own.sort(key=lambda k: (len(m.pieces[k]) > 1, -m.scores[k], k))
        self.piece_ids = np.array(own, np.int32)
        self.texts = [m.pieces[k] for k in own]
        self.scores = m.scores[self.piece_ids]
        self.index = PieceIndex(self.texts, list(range(len(own))))
        self.pair_codes = np.unique(np.array([(ord(a) << 32) | ord(b) for p in self.texts for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.unknown = next((k for k, kind in enumerate(m.kinds) if kind == UNKNOWN), 0)
        self.byte_ids = {int(m.pieces[k][3:5], 16): k for k, kind in enumerate(m.kinds) if kind == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind == NORMAL else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" for p, kind in zip(m.pieces, m.kinds, strict=True)]
        if m.is_bpe:
            self._prepare_merges()

    def release(self) -> None:
        """Forget the words."""
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _prepare_merges(self) -> None:
        number = {p: k for k, p in enumerate(self.texts)}
        n = len(self.texts)
        self.left, self.right, self.whole = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), np.ones(n, bool)
        for k, text in enumerate(self.texts):
            parts = [number.get(c, _STRANGE) for c in text]
            names = list(text)
            last = (k, k)
            while len(parts) > 1:
                found = min(((number.get(a + b, n), j) for j, (a, b) in enumerate(zip(names, names[1:], strict=False))))
                if found[0] == n:
                    break
                j = found[1]
                last = (parts[j], parts[j + 1])
                names[j : j + 2] = [names[j] + names[j + 1]]
                parts[j : j + 2] = [found[0]]
            self.whole[k] = parts == [k]
            if len(text) > 1 and self.whole[k]:
                self.left[k], self.right[k] = last
        hashes = np.empty(n, np.uint64)
        hashes[self.index.ids] = self.index.keys
        self.hashes, self.lengths = hashes, self.index.lengths
        # verdicts on pairs, each at the one place of its hash: exact, and of a fixed size
        self.known = np.full(1 << _SLOTS, -1, np.int64)
        self.verdicts = np.zeros(1 << _SLOTS, bool)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the piece that two pieces make together, or -1."""
        la, lb = self.lengths[a], self.lengths[b]
        out = np.full(len(a), -1, np.int32)
        fits = np.flatnonzero(la + lb <= self.index.longest)
        hashes = self.hashes[a[fits]] * self.index.powers[lb[fits]] + self.hashes[b[fits]]
        some = np.flatnonzero(self.index.filed[hashes >> np.uint64(64 - _TOP)])
        keys, ids, hashes = self.index.keys, self.index.ids, hashes[some]
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        out[fits[some]] = np.where(keys[at] == hashes, ids[at], -1)
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the pieces a, b apart; remembered by pair."""
        keys = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        at = ((keys * _MIX) >> (64 - _SLOTS)) & ((1 << _SLOTS) - 1)
        out = self.verdicts[at]
        new = np.flatnonzero(self.known[at] != keys)
        if len(new):
            out[new] = self._judge(a[new], b[new])
            self.known[at[new]], self.verdicts[at[new]] = keys[new], out[new]
            # two new pairs may share a place: the last key stands, with its own verdict
            again = new[self.known[at[new]] == keys[new]]
            self.verdicts[at[again]] = out[again]
        return out

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the pieces a, b apart when they meet.

        Merges are undone, latest first; the two stay apart if none that would cross
        comes before those that make the parts which meet.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != _STRANGE) & (b != _STRANGE))
        a, b = a[live].astype(np.int64), b[live].astype(np.int64)
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            c = self._joined(a, b)
            crossed = (c >= 0) & (c < limit)
            ok[live[crossed]] = False
            ra, lb = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            a_whole, b_whole = ra == a, lb == b
            undo_a = ((a > b) & ~a_whole) | ((a <= b) & b_whole & ~a_whole)
            go = ~crossed & ~(a_whole & b_whole)
            limit = np.where(undo_a, a, b + 1)[go]
            a, b = np.where(undo_a, ra, a)[go], np.where(undo_a, b, lb)[go]
            live = live[go]
        return ok

    def _paths(self, words: list[str], length: int):
        """By end: the number of the last piece on the path, and where that piece starts (steps back)."""
        n = len(words)
        h = prefix_hashes(codes(words, length))
        last = np.full((length + 1, n), _STRANGE, np.int32)
        back = np.ones((length + 1, n), np.int16)
        if not self.model.is_bpe:
            best = np.full((length + 1, n), -np.inf)
            best[0] = 0
            strange = self.scores.min(initial=0) - 10
        for end in range(1, length + 1):
            reach = range(min(self.index.longest, end), 0, -1)
            if self.model.is_bpe:
                open_ = np.arange(n)
                for k in reach:
                    found = self.index.lookup(h[end][open_] - h[end - k][open_] * self.index.powers[k], k)
                    good = found >= 0
                    good[good] = self.whole[found[good]]
                    if k < end and k > 1 and good.any():
                        good[good] = self._apart(last[end - k][open_[good]], found[good])
                    taken = open_[good]
                    last[end][taken], back[end][taken] = found[good], k
                    open_ = open_[~good]
                    if not len(open_):
                        break
                continue
            for k in reach:
                found = self.index.find(h, end - k, end)
                score = best[end - k] + np.where(found >= 0, self.scores[found], strange if k == 1 else -np.inf)
                better = score > best[end]
                best[end][better], last[end][better], back[end][better] = score[better], found[better], k
        return last, back

    def _encode_words(self, words: list[str]) -> None:
        for length, places in by_length(words):
            group = [words[k] for k in places]
            last, back = self._paths(group, length)
            n = len(group)
            at, rows, steps = np.full(n, length), np.arange(n), []
            while (on := at > 0).any():
                steps.append(np.where(on, last[at, rows], -2))
                at = np.where(on, at - back[at, rows], 0)
            table = np.array(steps[::-1]).T
            ids = np.where(table >= 0, self.piece_ids[np.maximum(table, 0)], np.where(table == _STRANGE, -1, -2)).astype(np.int32)
            counts = (ids != -2).sum(axis=1)
            strange = (ids == -1).any(axis=1)
            for k, word in enumerate(group):
                row = ids[k, ids.shape[1] - counts[k] :]
                self.cache[word] = (self._with_bytes(row, back[:, k], word) if strange[k] else row).tobytes()

    def _with_bytes(self, row: np.ndarray, back: np.ndarray, word: str) -> np.ndarray:
        out, at = [], 0
        for piece in row.tolist():
            size = 1 if piece == -1 else len(self.model.pieces[piece])
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[x] for x in word[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
            at += size
        return np.array(out, np.int32)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        found = _WORD.findall(text)
        if max(map(len, found)) <= _LONG:
            return found
        return [part for w in found for part in (self._cut(w) if len(w) > _LONG else (w,))]

    def _cut(self, word: str) -> list[str]:
        """A long word, cut where no piece holds the two characters that meet."""
        c = codes([word], len(word))[0].astype(np.int64)
        pairs = (c[:-1] << 32) | c[1:]
        at = np.minimum(np.searchsorted(self.pair_codes, pairs), len(self.pair_codes) - 1)
        cuts = [0, *(np.flatnonzero(self.pair_codes[at] != pairs) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece ids of each text."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(self.words(t or ""))
            size += len(block[-1])
            if size > 600_000:
                out += self._encode_block(block)
                block, size = [], 0
        return out + self._encode_block(block)

    def _encode_block(self, block: list[list[str]]) -> list[np.ndarray]:
        new, cache, older = [], self.cache, self.older
        for w in set().union(*block).difference(cache):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                cache[w] = ids
            self.held += 240 + 6 * len(w)  # about: two objects and their place in the table
        if new:
            self._encode_words(new)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in block]
        if self.held > self.cache_bytes:
            self.older, self.cache, self.held = cache, {}, 0
        return out

    def decode(self, ids) -> str:
        """The text of piece ids."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_crc32 (of the little-endian 32-bit ids), decodes (whether decoding
    gives the text back) and, if asked for, tokens (the ids).  Without ``with_text`` the text is left out.

    The model file must be readable at ``model`` by every executor.
    """
    taken = {c.lower() for c in docs.columns}
    names = {k: unused(docs, k) if k in taken else k for k in ("n_tokens", "ids_crc32", "decodes", "tokens")}  # clashing ones get a leading _
    at = docs.columns.index("text")
    kept = [c for c in docs.columns if with_text or c != "text"]

    def run(batches):
        c = codec(model)
        try:
            for whole in batches:
                for start in range(0, max(1, whole.num_rows), 1000):
                    batch = whole.slice(start, 1000)
                    texts = batch.column(at).to_pylist()
                    ids = c.encode(texts)
                    more = [
                        (names["n_tokens"], pa.array([len(x) for x in ids], pa.int64())),
                        (names["ids_crc32"], pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())),
                        (names["decodes"], pa.array([c.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())),
                    ]
                    if with_ids:
                        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                        more.append((names["tokens"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))))
                    own = [(k, batch.column(docs_columns.index(k))) for k in kept]
                    yield pa.RecordBatch.from_arrays([a for _, a in own + more], [k for k, _ in own + more])
        finally:
            c.release()  # the worker lives on

    docs_columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in kept) + f", {names['n_tokens']} bigint, {names['ids_crc32']} bigint, {names['decodes']} boolean" + (f", {names['tokens']} array<int>" if with_ids else "")
    return docs.mapInArrow(run, schema)
