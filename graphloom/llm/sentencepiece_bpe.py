"""Operator 3: SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding is exact, by backtracking: the longest vocabulary match at each position
comes from one Aho-Corasick pass, a token may follow another only if merging
their joint text again gives just these two, and a bitfield keeps the positions
from which no valid continuation exists. Pieces never hold a space mark after
another character, so a text is the concatenation of independent chunks (space
marks, then other characters). The distinct chunks of about a megabyte of texts are
encoded once, and a bounded table keeps those met before.

Models with user-defined or unused pieces are refused. Defined cases: a null or empty text has no tokens and decodes to the empty
string; characters outside the vocabulary become byte tokens; very long chunks
take time in proportion to their length; repeated rows give repeated results; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import textops as T
from graphloom.llm.shared import bounded_batches

SPACE = "▁"
#: Chunks that a worker remembers, twice: beyond, those not met lately go. Pairs of tokens are remembered up to twice as many.
MEMO = 150_000
#: Text whose distinct chunks are encoded together.
PART_BYTES = 1 << 20
_NORMAL, _UNKNOWN, _BYTE_KIND = 1, 2, 6
#: Control pieces never come out of a text.
_KINDS = {_NORMAL, _UNKNOWN, 3, _BYTE_KIND}


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        if any(p.type not in _KINDS for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.piece: list[str] = [p.piece for p in model.pieces]
        self.length = [len(p) for p in self.piece]
        self.plain: dict[int, str] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == _NORMAL:
                self.score[p.piece], self.id_of[p.piece] = p.score, i
                self.plain[i] = p.piece.replace(SPACE, " ")
            if p.type == _BYTE_KIND:
                self.byte_id[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece holds a space mark after another character")
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        after_letter = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in after_letter)
        # no piece has one of these marks after a letter, so nothing merges across such a place
        ends = f"{SPACE}*+[^\\W\\d_]++(?=[{re.escape(marks)}])|" if marks else ""
        self.chunks = re.compile(f"{ends}{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def merge(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost on ties. Only for texts of a token or two."""
        parts, score = list(text), self.score
        joint = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joint):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(joint):
                joint[at] = score.get(parts[at] + parts[at + 1])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces again gives just these two; asked for pairs that are not remembered."""
        a, b = self.piece[left], self.piece[right]
        if len(self.pairs) >= 2 * MEMO:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merge(a + b) == [a, b]
        return known

    def ids(self, text: str) -> list[int]:
        """Ids of a chunk. The leftmost longest matches are the first way that backtracking tries; mostly it needs no other."""
        out, last, at, pairs, length = [], -1, -1, self.pairs, self.length
        for end, i in self.automaton.iter_long(text):
            if end - length[i] != at:  # a character outside the vocabulary lies between
                break
            if last >= 0:
                known = pairs.get(last << 32 | i)
                if not (self.compatible(last, i) if known is None else known):
                    break
            out.append(i)
            last, at = i, end
        return out if at == len(text) - 1 else self.backtracked(text)

    def backtracked(self, text: str) -> list[int]:
        """Ids of a chunk by backtracking over the longest matches."""
        starts: list[list[int]] = [[] for _ in text]
        length = self.length
        for end, i in self.automaton.iter(text):
            starts[end - length[i] + 1].append(i)  # from shorter to longer for each start
        failed, out, pos, size, pairs = bytearray(len(text) // 8 + 1), [], 0, len(text), self.pairs
        while pos < size:
            last = out[-1] if out else -1
            for i in reversed(starts[pos] or (-1,)):  # -1: a character outside the vocabulary, which joins nothing
                end = pos + (length[i] if i >= 0 else 1)
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last >= 0 and i >= 0:
                    known = pairs.get(last << 32 | i)
                    if not (self.compatible(last, i) if known is None else known):
                        continue
                out.append(i)
                pos = end
                break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                i = out.pop()
                pos -= length[i] if i >= 0 else 1
        if -1 not in out:
            return out
        ids, pos = [], 0
        for i in out:
            if i >= 0:
                ids.append(i)
                pos += length[i]
                continue
            ids += [self.byte_id[b] for b in text[pos].encode("utf-8")] if self.byte_id else [self.unknown]
            pos += 1
        return ids

    def surface(self, ids: list[int]) -> str:
        """Text of ids as it stands inside a sentence: bytes joined and decoded, marks turned into spaces."""
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])
        except KeyError:
            pass
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            else:
                out.append(self.plain.get(i, ""))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text[:1] == " " else text

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not remembered; each has an entry afterwards."""
        memo, old = self.memo, self.old
        if len(memo) > MEMO:
            self.old, self.memo = memo, {}
            memo, old = self.memo, self.old
        for chunk in chunks.difference(memo):
            entry = old.get(chunk)
            if entry is None:
                ids = self.ids(chunk)
                entry = ",".join(map(str, ids)), len(ids), self.surface(ids)
            memo[chunk] = entry

    def encode_texts(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, decoded text) of each whole text; distinct chunks are encoded once."""
        found = [self.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*found))
        entry, out = self.memo.__getitem__, []
        for chunks in found:
            parts = list(map(entry, chunks))
            decoded = "".join([p[2] for p in parts])
            out.append((",".join([p[0] for p in parts]), sum([p[1] for p in parts]), decoded[1:] if decoded[:1] == " " else decoded))
        for long in [c for c in set().union(*found) if len(c) > 256]:
            del self.memo[long]
        return out

    def encode_text(self, text: str | None) -> tuple[str, int, str]:
        return self.encode_texts([text])[0]


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded.

    Null and empty texts give zero tokens. The digests are lower-case hex SHA-256
    of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_path)
        for batch in batches:
            offsets = T.string_buffer(batch.column(1))[1]
            for i, j in T.chunks(offsets, PART_BYTES):
                part = batch.slice(i, j - i)
                rows = pieces.encode_texts(part.column(1).to_pylist())
                out = {
                    id_col: part.column(0),
                    "n_tokens": pa.array([r[1] for r in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
                }
                if keep_ids:
                    out["ids"] = pa.array([[int(x) for x in r[0].split(",")] if r[0] else [] for r in rows], pa.list_(pa.int32()))
                    out["decoded"] = pa.array([r[2] for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    extra = ", ids array<int>, decoded string" if keep_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
