"""Cross-tokenizer alignment by merge-path partitioning.

Both tokenizers cut a text's bytes; byte offsets where a token of A and one of B
end together close a group.  Finding them is a merge of two sorted lists of ends.
The merge path is the staircase that the merge walks; a binary search on the
diagonal ``i + j = d`` finds where it crosses, so diagonals ``work`` apart cut a
text into pieces of equal work that need nothing of each other.  A piece emits
the groups that it holds whole, and what lies before its first and after its last
common end; stitching joins these loose ends along a text.

Texts of one piece are merged where they were encoded.  The pieces of longer ones
are dealt out over all tasks and stitched in order, one loose end at a time.

Links are the pairs of tokens of a group.  A text keeps its distinct pairs and
how often each occurs; counts of texts a pair follow from one aggregate.  The
commonest ``MAX_BROADCAST_PAIRS`` pairs at most, by a threshold read off a histogram of
the counts, are broadcast; rarer pairs, none in more texts than the threshold,
are joined by shuffle.

Words are encoded once a million letters and kept in a table of bounded size: a
blank or an end of line after a character that is no white space starts a new word
in both vocabularies (which is checked when they are read), so encoding word by
word is encoding the text.

Defined results: null and empty texts, and texts whose tokens do not spell a blank
and the text, have no tokens, no groups and an empty string of groups; repeated
rows and ids are texts of their own; a very long text is encoded in one task and
merged in many; ties in counts are all best; an empty table gives no rows.  Only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import materialise

#: Ends of A and B that a piece merges.
WORK = 1 << 16
#: Pairs are numbers: A's id times this, plus B's.
WIDTH = 1 << 20
MAX_BROADCAST_PAIRS = 1 << 18
WORDS_KEPT = 400_000
LONG = 64
#: Letters whose new words are encoded at a time.
LETTERS = 1 << 20
#: Values that an outgoing batch holds, about.
VALUES_OUT = 1 << 20
BLANK = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A vocabulary: the bytes of each token, and encoding of words."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled = spelled
        self.length = np.array([len(b) for b in spelled], np.int64)
        self.after = [np.array([f"{i}{c}" for i in range(len(spelled))], object) for c in ",|;"]

    def encode_each(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_joined(self, words: list[str]) -> list[int]:
        """The ids of words that may stand one after another in a text."""
        raise NotImplementedError

    def encode(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, how many each has, and whether they spell the word.
        ``plain`` words may be encoded in one call: they end in no white space."""
        text = "".join(plain)
        ids = self.encode_joined(plain) if plain else []
        found = self.encode_each(others) if others else []
        data = text.encode()
        lengths = np.fromiter(map(len, plain) if len(data) == len(text) else (len(w.encode()) for w in plain), np.int64, len(plain))
        upto = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(lengths), "right")
        sizes = np.concatenate([np.diff(upto, prepend=0), np.array([len(x) for x in found], np.int64)])
        whole = b"".join(map(self.spelled.__getitem__, ids)) == data
        good = [b"".join(map(self.spelled.__getitem__, x)) == w.encode() for x, w in zip(found, others, strict=True)]
        flat = np.array(ids + list(chain.from_iterable(found)), np.int32)
        return flat, sizes, np.concatenate([np.full(len(plain), whole), np.array(good, bool)])


class ByteSide(Side):
    """A byte-level vocabulary of the tokenizers library.  Short Latin words go
    through tiktoken, which merges the same pairs in the same order where a token's
    id is its rank; that is checked."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pre, model = data["pre_tokenizer"] or {}, data["model"]
        if data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("A must be a byte-level vocabulary without normalizer or prefix")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(_byte_letters())}
        spelled = [b""] * self.tokenizer.get_vocab_size()
        for token, i in model["vocab"].items():
            if set(token) <= set(byte_of):
                spelled[i] = bytes(byte_of[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][x + y] for x, y in pairs]
        ranks = {w: i for i, w in enumerate(spelled) if w}
        ranked = made == sorted(made) and sorted(ranks.values()) == sorted({*made, *(ranks[bytes([k])] for k in range(256))}) and max(ranks[bytes([k])] for k in range(256)) < made[0]
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        super().__init__(spelled)

    def encode_each(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(words), 1000):  # encodings are large before they are ids
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 1000], add_special_tokens=False)]
        return out

    def encode_joined(self, words: list[str]) -> list[int]:
        if self.quick is None:
            return list(chain.from_iterable(self.encode_each(words)))
        return self.quick.encode_ordinary("".join(words))


class PieceSide(Side):
    """A sentence-piece vocabulary, which puts a blank before each text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("B has pieces that hold a blank after a letter, or an end of line")
        byte = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes.fromhex(byte.fullmatch(p)[1]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])

    def encode_each(self, words: list[str]) -> list[list[int]]:
        """A word's first blank is the one that the model puts there; before an end of
        line that blank is a token of its own and is left out."""
        found = self.model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        one = [self.model.piece_to_id(BLANK)]
        return [one if w == " " else ids if w[0] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]

    def encode_joined(self, words: list[str]) -> list[int]:
        return self.encode_each(["".join(words)])[0]


#: ASCII and the Latin letters, whose classes are the same in all Unicode versions.
_LATIN = re.compile("[\x00-\x7f\u00c0-\u024f]*")


class Words:
    """The ids of both sides of the words met, in one flat array a side."""

    def __init__(self, both: tuple[Side, Side]) -> None:
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.good = np.zeros(1024, bool)
        self.at = [np.zeros(1025, np.int64) for _ in self.both]
        self.ids = [np.zeros(4096, np.int32) for _ in self.both]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new."""
        new = list(words.difference(self.number))
        if not new:
            return
        spelled = [spell(w) for w in new]
        odd = [len(w) > LONG or w[-1].isspace() or not (w.isascii() or _LATIN.fullmatch(w)) for w in spelled]
        order, plain = sorted(range(len(new)), key=odd.__getitem__), len(new) - sum(odd)
        first, last = len(self.number), len(self.number) + len(new)
        self.number.update((new[k], first + i) for i, k in enumerate(order))
        spelled = [spelled[k] for k in order]
        self.good = _room(self.good, last)
        self.good[first:last] = True
        for s, side in enumerate(self.both):
            ids, sizes, good = side.encode(spelled[:plain], spelled[plain:])
            self.good[first:last] &= good
            start = int(self.at[s][first])
            self.at[s] = _room(self.at[s], last + 1)
            self.at[s][first + 1 : last + 1] = start + np.cumsum(sizes)
            self.ids[s] = _room(self.ids[s], start + len(ids))
            self.ids[s][start : start + len(ids)] = ids

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of both sides of a text's words; none where they do not spell it."""
        k = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if not self.good[k].all():
            return [np.zeros(0, np.int64) for _ in self.both]
        out = []
        for at, ids in zip(self.at, self.ids, strict=True):
            start, size = at[k], at[k + 1] - at[k]
            ends = np.cumsum(size)
            place = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(k) else 0)
            out.append(ids[place].astype(np.int64))
        return out


def _room(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate([values, np.zeros(max(size - len(values), len(values)), values.dtype)])


@cache
def vocabularies(paths: tuple[str, str]) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the tasks'
    return Words((ByteSide(paths[0]), PieceSide(paths[1])))


#: White space before a blank or an end of line would join the next word.
_WHITE = r"\s\x1c-\x1f\x85"
_UNSAFE, _CUT = re.compile(f"[{_WHITE}][ \n]"), re.compile(f"(?<=[^{_WHITE}])(?=[ \n])")


def words_of(text: str | None) -> list[str]:
    """The words of a blank and ``text``: cut before a blank or an end of line that
    follows a character that is no white space.  A word that begins with neither
    has a blank before it (see ``spell``)."""
    if not text:
        return []
    if not _UNSAFE.search(text) and text[0] not in " \n":
        return text.replace("\n", " \n").split(" ")
    return _CUT.split(" " + text)


def spell(word: str) -> str:
    return word if word[:1] in (" ", "\n") and word else " " + word


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where the merge path of two ascending lists of ends crosses the diagonals
    ``work`` apart, with both corners.  Equal ends stay on one side of a cut."""
    total = len(a) + len(b)
    cuts = [(0, 0)]
    for d in range(work, total, work):
        low, high = max(0, d - len(b)), min(d, len(a))
        while low < high:
            i = (low + high) // 2
            if a[i] <= b[d - i - 1]:  # a's end i comes before the diagonal
                low = i + 1
            else:
                high = i
        i, j = low, d - low
        if i and j < len(b) and a[i - 1] == b[j]:
            j += 1
        if (i, j) != cuts[-1]:
            cuts.append((i, j))
    if cuts[-1] != (len(a), len(b)):
        cuts.append((len(a), len(b)))
    return cuts


class Piece:
    """The groups of a piece: ids and, for each token, how many common ends come before."""

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> None:
        at = np.searchsorted(b_ends, a_ends)
        both = np.zeros(len(a_ends), bool)
        inside = at < len(b_ends)
        both[inside] = b_ends[at[inside]] == a_ends[inside]
        there = np.zeros(len(b_ends), np.int64)
        there[at[both]] = 1
        self.a, self.b, self.n = a_ids, b_ids, int(both.sum())
        self.a_group, self.b_group = np.cumsum(both) - both, np.cumsum(there) - there

    def between(self, first: int, last: int) -> Piece:
        """The groups from ``first`` to before ``last``, alone."""
        out = Piece.__new__(Piece)
        (i, k), (j, m) = (np.searchsorted(g, (first, last)) for g in (self.a_group, self.b_group))
        out.a, out.b, out.n = self.a[i:k], self.b[j:m], max(last - first, 0)
        out.a_group, out.b_group = self.a_group[i:k] - first, self.b_group[j:m] - first
        return out

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of either side in each group."""
        return tuple(np.bincount(g, minlength=self.n)[: self.n] for g in (self.a_group, self.b_group))

    def links(self) -> int:
        a, b = self.sizes()
        return int(a @ b)

    def text(self, a: Side, b: Side) -> str:
        """a1,a2|b1;a3|b2,b3"""
        if not self.n:
            return ""
        a_size, b_size = self.sizes()
        a_place = np.arange(len(self.a)) + (np.cumsum(b_size) - b_size)[self.a_group]
        b_place = np.arange(len(self.b)) + np.cumsum(a_size)[self.b_group]
        out = np.empty(len(self.a) + len(self.b), object)
        for side, ids, group, place, mark in ((a, self.a, self.a_group, a_place, 1), (b, self.b, self.b_group, b_place, 2)):
            last = np.append(group[1:] != group[:-1], True)
            for k, some in ((0, ~last), (mark, last)):
                out[place[some]] = side.after[k][ids[some]]
        return "".join(out.tolist())[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs and how often each is linked.  A group that links many
        times its tokens is reduced to distinct tokens first."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a_size, b_size = self.sizes()
        if int(a_size @ b_size) > 8 * (len(self.a) + len(self.b)):
            return self._pairs_of_distinct()
        reach = b_size[self.a_group]
        ends = np.cumsum(reach)
        left = np.repeat(self.a * WIDTH, reach)
        right = np.repeat((np.cumsum(b_size) - b_size)[self.a_group] - (ends - reach), reach) + np.arange(ends[-1])
        keys = np.sort(left + self.b[right])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[starts], np.diff(starts, append=len(keys))

    def _pairs_of_distinct(self) -> tuple[np.ndarray, np.ndarray]:
        runs = []
        for ids, group in ((self.a, self.a_group), (self.b, self.b_group)):
            keys, times = np.unique(group * WIDTH + ids, return_counts=True)
            runs.append((keys // WIDTH, keys % WIDTH, times))
        (ga, ia, ka), (gb, ib, kb) = runs
        start, size = np.searchsorted(gb, np.arange(self.n)), np.bincount(gb, minlength=self.n)
        reach = size[ga]
        left = np.repeat(np.arange(len(ga)), reach)
        right = np.repeat(start[ga] - (np.cumsum(reach) - reach), reach) + np.arange(len(left))
        keys, times = ia[left] * WIDTH + ib[right], ka[left] * kb[right]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[starts], np.add.reduceat(times, starts)


_ARROW = {
    "row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "a_ids": pa.list_(pa.int64()), "b_ids": pa.list_(pa.int64()), "a_ends": pa.list_(pa.int64()), "b_ends": pa.list_(pa.int64()),
    "groups": pa.string(), "closes": pa.bool_(), "head_a": pa.list_(pa.int64()), "head_b": pa.list_(pa.int64()), "tail_a": pa.list_(pa.int64()), "tail_b": pa.list_(pa.int64()),
}
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
_WHOLE = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
ENCODED = ("row", "doc_id", "piece", *_WHOLE, "a_ids", "b_ids", "a_ends", "b_ends")
MERGED = ("row", "piece", "n_a", "n_b", "n_groups", "n_links", "groups", "closes", "head_a", "head_b", "tail_a", "tail_b", "pairs", "times")
STITCHED = ("row", *_WHOLE)


def _ddl(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {_SQL[_ARROW[n]]}" for n in names)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if kind != pa.list_(pa.int64()):
        return pa.array(values, kind)
    sizes = [0, *(0 if v is None else len(v) for v in values)]
    flat = [v for v in values if v is not None and len(v)]
    missing = pa.array([v is None for v in values])
    data = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), data, mask=missing)


def _in_batches(rows: Iterator[dict], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _ARROW[n]) for n in names])
    held: list[dict] = []
    values = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column([r.get(n) for r in held], _ARROW[n]) for n in names], schema=schema)

    for row in rows:
        held.append(row)
        values += 32 + sum(len(v) for v in row.values() if isinstance(v, np.ndarray | str))
        if values >= VALUES_OUT:
            yield batch()
            held, values = [], 0
    if held:
        yield batch()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of (row, doc_id, words), some million letters at a time."""
    held, letters = [], 0
    for batch in batches:
        for k in range(len(batch)):
            text = batch.column(2)[k].as_py()
            held.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), words_of(text)))
            letters += len(text or "")
            if letters >= LETTERS:
                yield held
                held, letters = [], 0
    if held:
        yield held


def _encoder(paths: tuple[str, str], work: int):
    """Rows (row, doc_id, text): texts of one piece with their groups, the others in pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = vocabularies(paths)
        a, b = known.both
        for chunk in _chunks(batches):
            known.learn(set(chain.from_iterable(words for _, _, words in chunk)))
            for row, doc_id, words in chunk:
                own = {"row": row, "doc_id": doc_id}
                a_ids, b_ids = known.encode(words)
                a_ends, b_ends = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
                cuts = diagonal_cuts(a_ends, b_ends, work)
                if len(cuts) <= 2:
                    p = Piece(a_ids, b_ids, a_ends, b_ends)
                    pairs, times = p.pairs()
                    yield own | {"n_a": len(a_ids), "n_b": len(b_ids), "n_groups": p.n, "n_links": p.links(), "groups_sha256": _sha(p.text(a, b)), "pairs": pairs, "times": times}
                    continue
                for n, ((i, j), (k, m)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    yield own | {"piece": n, "a_ids": a_ids[i:k], "b_ids": b_ids[j:m], "a_ends": a_ends[i:k], "b_ends": b_ends[j:m]}
            if len(known.number) > WORDS_KEPT:
                known.clear()

    return lambda batches: _in_batches(rows(batches), ENCODED)


def _arrays(batch: pa.RecordBatch, k: int, first: int) -> list[np.ndarray]:
    return [np.array(c[k].values.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns[first:]]


def _merger(paths: tuple[str, str]):
    """Pieces (row, piece, ids and ends of both sides): their whole groups and loose ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = vocabularies(paths).both
        for batch in batches:
            for k in range(len(batch)):
                whole = Piece(*_arrays(batch, k, 2))
                head, inner, tail = whole.between(0, 1), whole.between(1, whole.n), whole.between(max(whole.n, 1), len(whole.a) + len(whole.b) + 1)
                pairs, times = inner.pairs()
                yield {
                    "row": batch.column(0)[k].as_py(), "piece": batch.column(1)[k].as_py(), "n_a": len(whole.a), "n_b": len(whole.b),
                    "n_groups": inner.n, "n_links": inner.links(), "groups": inner.text(a, b), "closes": whole.n > 0,
                    "head_a": head.a, "head_b": head.b, "tail_a": tail.a, "tail_b": tail.b, "pairs": pairs, "times": times,
                }

    return lambda batches: _in_batches(rows(batches), MERGED)


class _Stitch:
    """One text, piece by piece; the pairs of its stitched groups are held, those of
    its pieces passed on."""

    def __init__(self, row: int) -> None:
        self.row, self.sha = row, hashlib.sha256()
        self.n = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []

    def _say(self, text: str) -> None:
        if text:
            self.sha.update((";" if self.said else "").encode() + text.encode())

    @property
    def said(self) -> bool:
        return self.n["n_groups"] > 0

    def add(self, piece: dict, a: Side, b: Side) -> Iterator[dict]:
        self.n["n_a"] += piece["n_a"]
        self.n["n_b"] += piece["n_b"]
        self.loose.append((piece["head_a"], piece["head_b"]))
        if not piece["closes"]:
            return
        joined = Piece.__new__(Piece)
        joined.a, joined.b = (np.concatenate([x[s] for x in self.loose]) for s in (0, 1))
        joined.n, joined.a_group, joined.b_group = 1, np.zeros(len(joined.a), np.int64), np.zeros(len(joined.b), np.int64)
        self._say(joined.text(a, b))
        self.n["n_groups"] += 1
        self.n["n_links"] += joined.links()
        self._say(piece["groups"])
        self.n["n_groups"] += piece["n_groups"]
        self.n["n_links"] += piece["n_links"]
        self.loose = [(piece["tail_a"], piece["tail_b"])]
        pairs, times = joined.pairs()
        yield {"row": self.row, "pairs": pairs, "times": times}

    def end(self) -> dict:
        return {"row": self.row, **self.n, "groups_sha256": self.sha.hexdigest()}


def _stitcher(paths: tuple[str, str]):
    """Merged pieces, sorted by (row, piece): a row with the figures of each text, and
    rows with pairs of its stitched groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = vocabularies(paths).both
        text: _Stitch | None = None
        for batch in batches:
            for k in range(len(batch)):
                piece = {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                piece |= {n: np.array(piece[n], np.int64) for n in ("head_a", "head_b", "tail_a", "tail_b")}
                if text is None or text.row != piece["row"]:
                    if text is not None:
                        yield text.end()
                    text = _Stitch(piece["row"])
                yield from text.add(piece, a, b)
        if text is not None:
            yield text.end()

    return lambda batches: _in_batches(rows(batches), STITCHED)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, work: int = WORK, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256), a row a text, and
    (row, pairs, times): the distinct linked pairs of each text and how often they
    occur, a row a text or, for texts of many pieces, several with pairs of their own.

    ``row`` is a number of the text's own.  A pair is A's id times ``WIDTH`` plus B's.
    """
    paths = paths or default_paths()
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    encoded = materialise(own.mapInArrow(_encoder(paths, work), _ddl(ENCODED)), "encoded")
    short = encoded.filter("piece IS NULL")
    long = encoded.filter("piece IS NOT NULL")
    pieces = long.select("row", "piece", "a_ids", "b_ids", "a_ends", "b_ends").repartition("row", "piece")
    merged = materialise(pieces.mapInArrow(_merger(paths), _ddl(MERGED)), "merged")
    in_order = merged.select(*[c for c in MERGED if c not in ("pairs", "times")]).repartition("row").sortWithinPartitions("row", "piece")
    stitched = materialise(in_order.mapInArrow(_stitcher(paths), _ddl(STITCHED)), "stitched")
    figures = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    ids = long.filter("piece = 0").select("row", "doc_id")
    whole = stitched.filter("n_a IS NOT NULL").join(ids, "row").select("row", "doc_id", *figures)
    links = merged.select("row", "pairs", "times").unionByName(stitched.filter("pairs IS NOT NULL").select("row", "pairs", "times"))
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("row", "x.pairs").agg(F.sum("x.times").alias("times"))
    again = each.select("row", F.array("pairs").alias("pairs"), F.array("times").alias("times"))
    return short.select("row", "doc_id", *figures).unionByName(whole), short.select("row", "pairs", "times").unionByName(again)


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their counts."""
    classes = counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("k")).count().collect()
    least, total = 0, 0
    for k, size in sorted(((r["k"], r["count"]) for r in classes), reverse=True):
        total += size
        if total > most:
            least = k + 1
            break
    return 1 << least


def a_of(pair: Column) -> Column:
    return F.shiftright(pair, WIDTH.bit_length() - 1)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts each pair is linked, and whether no pair of
    its A token is in more.  ``links`` has row and pairs, each pair once a row."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialise(counts, "pairs")
    most = counts.groupBy(a_of(F.col("pair")).alias("a")).agg(F.max("n").alias("most"))  # a row a token of A at most
    c = counts.withColumn("a", a_of(F.col("pair"))).join(F.broadcast(most), "a")
    return c.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(links: DataFrame, counts: DataFrame, most: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of texts with links: how many are of a best pair, and
    the sum of their counts."""
    least = _threshold(counts, most)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    common = F.broadcast(counts.filter(F.col("n") >= least))  # ``most`` rows at most, by the histogram
    add = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    if least == 1:
        return each.join(common, "pair").groupBy("row").agg(*add)
    met = each.join(common, "pair", "left")
    rare = met.filter("n IS NULL").select("row", "pair", "times").join(counts.filter(F.col("n") < least), "pair")
    parts = met.filter("n IS NOT NULL").groupBy("row").agg(*add).unionByName(rare.groupBy("row").agg(*add))
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
