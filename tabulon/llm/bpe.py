"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in rank order, by successive merge gadgets.  Running
the gadget of ``a b -> ab`` over the automaton of the earlier merges

* gives every state that reads ``a`` an arc ``ab``,
* lets that arc end in the state that ``b`` then led to, and
* moves the arcs of ``a`` to a copy of their target that has lost the arc ``b``.

So all arcs with one label end in one state, and the state after label ``u`` is
the state after its right part as it was when ``u`` was made, less the arcs that
later gadgets took from it.  The compiled form is that of automata with default
arcs: for each state its parent, its rank and the arcs it lost.  The full table of
49k x 49k transitions is written out for a stated set of states, the first
``DENSE`` labels in the order of their making.  There each gadget's lost arcs are
one rectangle: the labels that end in ``a`` by parts made later, times those that
begin with ``b``, both numbered so that such labels lie together.  The language
of the automaton holds exactly one label sequence for each word: its BPE tokens.

Encoding follows the table, or beyond it the default arcs, through a trie of the
labels, the longest label first; a position that led nowhere is not tried again.
Decoding emits the labels of the arcs.  Words are pre-split as the vocabulary file
says; a file with settings that are not known here is refused.  Each worker keeps
the results of the words it has met in a table of bounded size.

Defined results: a null text is an empty one and has no tokens; repeated rows
give repeated results; the strings of special tokens inside a text become those
tokens; a very long text is encoded whole, and words over ``LONG`` letters are
not kept; an empty table gives an empty result; other columns are not read.
Letters and lower case are those of the Unicode version of the ``regex`` module
and of Python, so characters added to Unicode since may be split otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bounds of what an idle worker holds between stages: some 40 MB together.
WORDS_KEPT = 100_000
ARCS_KEPT = 150_000
LONG = 64
#: States whose transitions are written out: a byte each, 4 MB.
DENSE = 2048
ROWS_OUT = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class Automaton:
    """The tables that the merge gadgets leave, over labels numbered by id."""

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str, symbols: dict[str, int] | None = None):
        """``symbols`` numbers the letters of labels below 256, as ``walk`` gets them."""
        n = max(vocab.values()) + 1
        self.labels = [""] * n
        for label, i in vocab.items():
            self.labels[i] = label
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.lost: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        self.width = n
        made = set(vocab.values()) - {vocab[a + b] for a, b in merges}
        for r, (x, y) in enumerate(merges):
            self._gadget(r, vocab[x], vocab[y], vocab[x + y], made)
        self._write_out(made)
        self._grow_trie(sorted(made), end, symbols)

    def _grow_trie(self, made: list[int], end: str, symbols: dict[str, int] | None) -> None:
        """``goto`` from (node, symbol); the labels that end at a node, within a word
        and at its end; and for each label the next shorter one that begins it."""
        bare = {i: self.labels[i].removesuffix(end) for i in made}
        self.symbols = symbols or {c: k for k, c in enumerate(sorted(set("".join(bare.values()))))}
        self.goto: dict[int, int] = {}
        self.mids, self.ends = [-1], [-1]
        for i in made:
            node = 0
            for c in bare[i]:
                node = self.goto.setdefault(node << 8 | self.symbols[c], len(self.mids))
                if node == len(self.mids):
                    self.mids.append(-1)
                    self.ends.append(-1)
            (self.ends if self.labels[i].endswith(end) else self.mids)[node] = i
        self.size, self.shorter = [0] * self.width, [-1] * self.width
        for i in made:
            self.size[i] = len(bare[i])
            node = 0
            for c in bare[i][:-1]:
                node = self.goto[node << 8 | self.symbols[c]]
                if self.mids[node] >= 0:
                    self.shorter[i] = self.mids[node]

    def _write_out(self, made: set[int]) -> None:
        """``table``: the transitions between the first ``DENSE`` labels, a row a
        state; ``row`` and ``col`` number the labels, -1 for the others."""
        some = sorted(made, key=lambda i: (self.rank[i], i))[:DENSE]
        size = len(some)
        row, row_end = self._numbered(some, self.right)
        col, col_end = self._numbered(some, self.left)
        table = np.ones((size, size), np.uint8)
        for (x, y), r in self.lost.items():
            if x in row and y in col:
                table[row[x] : row_end(x, r), col[y] : col_end(y, r - 1)] = 0
        self.table = table.tobytes()
        self.row, self.col = [-1] * self.width, [-1] * self.width
        for i in some:
            self.row[i], self.col[i] = row[i] * size, col[i]

    def _numbered(self, some: list[int], part: list[int]):
        """A number for each label, those made of it (as ``part``) following it, the
        latest first; and where those made after a rank end."""
        under: dict[int, list[int]] = {}
        for i in some:
            under.setdefault(part[i], []).append(i)
        at: dict[int, int] = {}
        end: dict[int, int] = {}
        stack = [(i, False) for i in under.get(-1, [])]
        while stack:
            i, done = stack.pop()
            if done:
                end[i] = len(at)
                continue
            at[i] = len(at)
            stack.append((i, True))
            stack += [(j, False) for j in under.get(i, [])]  # by rank: the last is taken first

        def end_of(i: int, r: int) -> int:
            later = [j for j in under.get(i, []) if self.rank[j] > r]
            return end[later[0]] if later else at[i] + 1

        return at, end_of

    def _gadget(self, r: int, a: int, b: int, ab: int, made: set[int]) -> None:
        if a in made and b in made and self._reads(a, b, r):
            self.rank[ab], self.left[ab], self.right[ab] = r, a, b
            self.lost[a, b] = r
            made.add(ab)

    def _reads(self, u: int, v: int, time: int) -> bool:
        """Whether the state after ``u`` has an arc ``v`` before gadget ``time``."""
        rank, lost = self.rank, self.lost
        while True:
            if lost.get((u, v), time) < time:
                return False
            at_u, at_v = rank[u], rank[v]
            if at_u > at_v:  # the state was that of the right part when u was made
                u, time = self.right[u], at_u
            elif at_v >= 0:  # the arc came where the left part could be read, this gadget's loss counted
                v, time = self.left[v], at_v + 1
            else:
                return True

    def can_follow(self, u: int, v: int) -> bool:
        """Whether the state after ``u`` has an arc ``v``."""
        r, c = self.row[u], self.col[v]
        if r >= 0 and c >= 0:
            return self.table[r + c] == 1
        key = u * self.width + v
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= ARCS_KEPT:
                self.known.clear()
            found = self.known[key] = self._reads(u, v, 1 << 60)
        return found

    def path(self, symbols: str) -> list[int]:
        """The labels of the only accepted path over a word's symbols."""
        return self.walk(bytes(self.symbols[c] for c in symbols))

    def walk(self, word: bytes) -> list[int]:
        """As ``path``, over numbered symbols.  A position can be reached by one
        label only, so one that led nowhere is left out from then on."""
        n, goto, mids, size, shorter, follow = len(word), self.goto, self.mids, self.size, self.shorter, self.can_follow
        out: list[int] = []
        left: list[int] = []
        dead: set[int] = set()
        j, u = 0, self.START
        while j < n:
            node, k, v = 0, j, -1
            while k < n:
                node = goto.get(node << 8 | word[k])
                if node is None:
                    break
                k += 1
                if k < n and mids[node] >= 0:
                    v = mids[node]
            if node is not None:
                last = self.ends[node]
                if last >= 0 and (u < 0 or follow(u, last)):
                    out.append(last)
                    return out
            while True:  # the longest arc left, else a step back
                while v >= 0 and (j + size[v] in dead or (u >= 0 and not follow(u, v))):
                    v = shorter[v]
                if v >= 0:
                    out.append(v)
                    left.append(shorter[v])
                    j, u = j + size[v], v
                    break
                dead.add(j)
                if not out:
                    raise ValueError(f"no token for a symbol of {word!r}")
                j, v = j - size[out.pop()], left.pop()
                u = out[-1] if out else self.START
        return out


def _part(spec: dict | None, kind: str) -> list[dict]:
    """The steps of a normaliser or splitter."""
    if spec is None:
        return []
    return spec[f"{kind}s"] if spec["type"] == "Sequence" else [spec]


def _known_settings(spec: dict) -> tuple[list[str], str]:
    """(normaliser steps, splitting pattern) of a vocabulary file; other settings
    than these would give other ids, so they are refused."""
    steps = []
    for x in _part(spec.get("normalizer"), "normalizer"):
        space = x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if x != {"type": x["type"]} and not space or x["type"] not in ("NFC", "Lowercase", "Replace"):
            raise ValueError(f"unknown normaliser {x}")
        steps.append(x["type"])
    split = _part(spec.get("pre_tokenizer"), "pretokenizer")
    if [x["type"] for x in split] != ["Split", "ByteLevel"]:
        raise ValueError("words are split by one pattern, then into bytes")
    cut, by_byte = split
    if cut["behavior"] != "Removed" or not cut["invert"] or by_byte["add_prefix_space"] or by_byte["use_regex"]:
        raise ValueError("unknown settings of the splitter")
    model = spec["model"]
    plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    if any(model.get(k, v) != v for k, v in plain.items()) or not model.get("end_of_word_suffix"):
        raise ValueError("unknown settings of the model")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("unknown settings of an added token")
    if spec.get("decoder") is not None or spec.get("post_processor") is not None:
        raise ValueError("a decoder or post-processor is not known here")
    return steps, cut["pattern"]["Regex"]


class Tokenizer:
    """Pre-splitting, the automaton, and the words met so far."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        self.steps, pattern = _known_settings(spec)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"], {c: b for b, c in enumerate(_byte_letters())})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels + [""] * (max(self.special.values(), default=-1) + 1 - len(self.automaton.labels))
        for label, i in self.special.items():
            self.labels[i] = label
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(pattern.replace("\\s", SPACE))
        # the same classes where a text is ASCII
        ascii_pattern = pattern.replace("\\s", "\\t-\\r ").replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9")
        self.ascii_words = re.compile(ascii_pattern) if "\\p" not in ascii_pattern else self.words
        #: words met, and those met before these; the older ones go first
        self.met: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            found = self.automaton.walk(word.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONG:
            if len(self.met) >= WORDS_KEPT:
                self.met, self.old = {}, self.met
            self.met[word] = ids
        return ids

    def _normal(self, text: str) -> str:
        plain = text.isascii()
        for step in self.steps:
            if step == "NFC" and not plain:
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = text.lower() if plain else text.replace("Σ", "σ").lower()
        return text  # white space separates words whatever it is replaced by

    def _plain(self, text: str) -> bytes:
        text = self._normal(text)
        words = (self.ascii_words if text.isascii() else self.words).findall(text)
        new, out = self._word, []
        for k in range(0, len(words), 4096):  # ``met`` may be another table afterwards
            get = self.met.get
            out += [get(w) or new(w) for w in words[k : k + 4096]]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or self.cut.search(text) is None:
            return self._plain(text)
        return b"".join(
            self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in memoryview(ids).cast("I")])


#: Tokenizers of this worker process, by the digest of their file.
_KEPT: dict[str, Tokenizer] = {}


def tokenizer(digest: str, file) -> Tokenizer:
    """One a worker process; tasks that follow find its tables filled."""
    if digest not in _KEPT:
        if len(_KEPT) >= 2:
            _KEPT.clear()
        _KEPT[digest] = Tokenizer(file.value)
    return _KEPT[digest]


def _shipped(spark: SparkSession, vocabulary: str | None) -> tuple:
    """(digest, broadcast) of the vocabulary file: a few MB that the driver reads,
    so that executors need no copy of it."""
    data = Path(vocabulary or default_vocabulary()).read_bytes()
    _known_settings(json.loads(data))
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def encode(
    docs: DataFrame, vocabulary: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids[, decoded]): ``ids`` packs little-endian 32-bit numbers.

    ``decoded`` adds the text that the ids decode to.  ``vocabulary`` is the path
    of a tokenizer file on the driver.
    """
    shipped = _shipped(docs.sparkSession, vocabulary)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(*shipped)
        for b in batches:
            for k in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(k, ROWS_OUT)
                ids = [t.encode(x.as_py()) for x in part.column(1)]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["id", "n_tokens", "ids"]
                if decoded:
                    columns.append(pa.array([t.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from packed ids; null ids give an empty text."""
    shipped = _shipped(tokens.sparkSession, vocabulary)
    source = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(*shipped)
        for b in batches:
            for k in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(k, ROWS_OUT)
                texts = [t.decode(x.as_py() or b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
