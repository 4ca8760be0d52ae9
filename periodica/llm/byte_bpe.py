"""Byte-level BPE by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded, pieces, texts, trim

#: Pieces whose encodings a worker remembers at once.
REMEMBERED = 250_000


class PrefixBPE:
    """Encodes bytes by the ranks of a byte-pair vocabulary.

    For every prefix of the input there is exactly one last token that its own encoding can end in: the
    one that is valid beside the last token of what precedes it. `extend` stores that token per prefix,
    so bytes can be appended without looking back further than the longest token, and `splice`
    re-encodes near an edit only.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Finds all tokens that end at each byte; bytes are read as Latin-1.
        self.ends = ahocorasick.Automaton()
        for data, token in ranks.items():
            if len(data) == 1 or self._parts(token) is not None:
                self.ends.add_word(data.decode("latin-1"), (token, len(data)))
        self.ends.make_automaton()
        self._fits: dict[int, bool] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or if merging its bytes doesn't give it."""
        if token not in self.halves:
            get, parts = self.ranks.get, [bytes([x]) for x in self.token[token]]
            while len(parts) > 2:
                rank, i = min((get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (get(parts[0]), get(parts[1])) if len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks else None
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether an encoding can hold `left` and then `right`: nothing merges across their border before they are made.

        The later-made of the two is undone step by step; what touches the border must not merge
        earlier than the token that it became.
        """
        limit = 1 << 60
        while True:
            merged = self.ranks.get(self.token[left] + self.token[right])
            if merged is not None and merged < limit:
                return False
            first, second = self._parts(left), self._parts(right)
            if first is None and second is None:
                return True
            if second is None or first is not None and left > right:
                limit, left = left, first[1]
            else:
                limit, right = right + 1, second[0]

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """Fill last[i], the last token of the encoding of data[: i + 1], for i from start to the end of data."""
        last[start:] = [-1] * (len(data) - start)
        known, near = self._fits, max(0, start - self.longest)
        for end, (token, size) in self.ends.iter(data[near:].decode("latin-1")):
            end += near
            if end >= start and last[end] < 0:  # a prefix has one such token only
                if size <= end:
                    before = last[end - size]
                    if before < 0:
                        continue
                    pair = before << 32 | token
                    if (ok := known.get(pair)) is None:
                        if len(known) > 4 * REMEMBERED:
                            known.clear()
                        ok = known[pair] = self.fits(before, token)
                    if not ok:
                        continue
                last[end] = token
        if start < len(last) and min(last[start:]) < 0:
            raise ValueError("a byte of the text is no token")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding, read backwards from the last token of the whole."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.token[last[i - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, [], 0))

    def splice(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """Replace data[at : at + removed]; prefixes that end before `at` keep their tokens.

        A prefix's last token follows from its last bytes and the last tokens of the prefixes that end within them. So once as many
        new tokens behind the edit as the longest token has bytes are the old ones, all further ones are.
        """
        old, shift = last[at + removed :], at + len(added)
        data = data[:at] + added + data[at + removed :]
        out, done, step = last[:at], shift, 4 * self.longest
        while done < len(data):
            end = min(len(data), done + step)
            self.extend(data[:end], out, len(out))
            same = 0
            for i in range(end - 1, shift - 1, -1):
                if out[i] != old[i - shift]:
                    break
                same += 1
            if same >= self.longest:
                return data, out + old[end - shift :]
            done, step = end, 2 * step
        return data, self.extend(data, out, len(out)) if len(out) < len(data) else out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Recent(dict):
    """A dict of two generations: when the young one is full, it becomes the old one; what is used again is young again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class TextBPE:
    """Encodes texts: each match of the pattern by itself; chunks between single spaces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.bpe = PrefixBPE(ranks)
        self.split = regex.compile(pattern).findall
        self.known = Recent(self._chunk, remembered)
        self.matches = Recent(self._match, remembered // 2)

    def _match(self, text: str) -> tuple[int, ...]:
        return tuple(self.bpe.encode(text.encode()))

    def _chunk(self, text: str) -> tuple[str, int, bytes]:
        """Ids as text, their number, and the bytes they decode to."""
        ids = [x for m in self.split(text) for x in self.matches[m]]
        return " ".join(map(str, ids)), len(ids), self.bpe.decode(ids)

    def chunks(self, text: str) -> list[str]:
        """Parts that the pattern treats alike on their own: white space after anything else always begins a match."""
        if _RUN.search(text):
            return _PART.findall(text)
        parts = text.split(" ")
        return [x for x in [parts[0], *[" " + x for x in parts[1:]]] if x]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text and of the decoded bytes."""
        found = list(map(self.known.__getitem__, self.chunks(text)))
        ids = " ".join([x[0] for x in found]).encode()
        return sum([x[1] for x in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([x[2] for x in found])).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(y) for x in self.chunks(text) for y in self.known[x][0].split(" ")]


#: White space before a space, or at the end, needs the pattern's look-ahead over the whole run.
_RUN = re.compile(r"\s |\s\Z|\A\s")
_PART = re.compile(r"\s*\S+|\s+")


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from a file's bytes: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines.split(b"\n")))}


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str, remembered: int = REMEMBERED) -> TextBPE:
    with open(path, "rb") as file:
        return TextBPE(load_ranks(file.read()), pattern, remembered)


def encode_documents(documents: DataFrame, vocabulary: str, pattern: str, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with `ids` also the ids and the decoded text.

    remembered: chunks that a worker remembers; it decides time and memory, no result.
    vocabulary: path of a rank file that is installed on every worker. One pass without a shuffle; a null text is empty,
    the empty text has no tokens, repeated rows and null doc_ids give a row each.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        coder = _coder(vocabulary, pattern, remembered)
        for batch in pieces(batches, "text"):
            found = batch.column("text").to_pylist()
            counts, hashes, decoded = zip(*map(coder.digest, found), strict=True)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                each = [coder.encode(x) for x in found]
                columns += [pa.array(each, pa.list_(pa.int32())), pa.array([coder.bpe.decode(x).decode("utf-8", "replace") for x in each], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    bounded(documents.sparkSession)
    return texts(documents).mapInArrow(run, schema)
