"""SentencePiece encoding and decoding with a streaming Viterbi search over the pieces' scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import map_text, named, slices
from .lattice import LITERAL, PieceTrie, best_paths, blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
TRIM = 4096
MEMO = 1 << 16


class _Words(dict):
    """From a string to its number; new strings are listed until they are solved."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class PieceCoder:
    """A vocabulary with scores: text to the ids of its best segmentation, and back.

    The best segmentation has the largest sum of scores; of equal sums the one whose last piece is longer wins, from the end
    to the front. Control pieces never match text. A character that no piece covers costs the lowest score less 10 and
    becomes its UTF-8 bytes, where the vocabulary has byte pieces, or else the unknown id. A blank is written as U+2581 and
    one more is put before the text; a U+2581 of the text itself goes to bytes, so that decoding gives back every text.
    """

    def __init__(self, proto: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids: list[int | None] = [None] * 256
        self.scores = np.full(n, -np.inf)  # by id
        pieces = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = (len(piece), sp.get_score(i), i)
                self.scores[i] = sp.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.lossless = all(x is not None for x in self.byte_ids)
        self.longest = max(map(len, pieces))
        self.unknown_score = min(s for _, s, _ in pieces.values()) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for piece, value in pieces.items():
            self.machine.add_word(piece, value)
        self.machine.make_automaton()
        known = {p: i for p, (_, _, i) in pieces.items()}
        for b, i in enumerate(self.byte_ids[:128]):  # ASCII that is no piece is one byte piece
            if self.lossless and chr(b) not in known:
                known[chr(b)], self.scores[i] = i, self.unknown_score
        self.trie = PieceTrie(known)
        #: Bytes of each id, and again without a blank at their beginning: for the first id of a text.
        self.spelled = pa.array([*self.bytes_of, *(x[1:] if x[:1] == b" " else x for x in self.bytes_of)], pa.binary())
        self.spells = np.array([len(x) > 0 for x in self.bytes_of])
        #: No piece has a blank after another sign, or a line end, so the back pointers of every text meet before a word's blank and
        #: on both sides of a line end: what is before is final there, and the stretches between are solved by themselves.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        self.words = _Words()
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the words so far

    @staticmethod
    def _stretches(text: str) -> list[str]:
        """The text from one place where all back pointers meet to the next. A word stands for itself with one blank before it;
        what begins with a blank or a line end stands as it is."""
        t = text.replace("\n", " \n")
        if "  " not in t and t[0] != " " and t[-1] != " ":
            return t.split(" ")
        found = re.findall("\n[^ \n]*| *[^ \n]+| +", " " + text)
        return [x[1:] if x[0] == " " and x[1:2] not in ("", " ") else x for x in found]

    @staticmethod
    def _spelling(word: str) -> str:
        return word.replace(" ", SPACE) if word[0] in " \n" else SPACE + word

    def _solve(self) -> None:
        """Ids of the new words: of most in one go, of the very long ones and those with raw bytes by the window."""
        new = [self._spelling(w) for w in self.words.new]
        found: list[np.ndarray | None] = [None] * len(new)
        for block in blocks(self.trie, new):
            ids, counts, _ = best_paths(block, self.scores, self.unknown_score)
            ends = np.cumsum(counts)
            raw = np.add.reduceat(ids < 0, ends - counts) > 0
            for i, a, b, odd in zip(block.which.tolist(), (ends - counts).tolist(), ends.tolist(), raw.tolist(), strict=True):
                if not odd:
                    found[i] = ids[a:b]
        made = [np.array(self.best(w), np.int32) if x is None else x for w, x in zip(new, found, strict=True)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, *made]), np.concatenate([self.counts, counts])
        self.words.new.clear()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's end."""
        if not self.by_word:
            made = [np.array(self.best((SPACE + x.replace(SPACE, LITERAL).replace(" ", SPACE)) if x else ""), np.int32) for x in texts]
            return np.concatenate([*made, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, made)])
        if len(self.words) > MEMO:
            self.words = _Words()
            self.ids, self.starts, self.counts = self.ids[:0], self.starts[:0], self.counts[:0]
        cut: list[str] = []
        places = [0]
        for x in texts:
            if x:
                cut += self._stretches(x.replace(SPACE, LITERAL))
            places.append(len(cut))
        which = np.fromiter(map(self.words.__getitem__, cut), np.int64, len(cut))
        self._solve()
        counts = self.counts[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        at = np.repeat(self.starts[which] - ends[:-1], counts) + np.arange(ends[-1])
        return self.ids[at], ends[places]

    def best(self, text: str) -> list[int]:
        """Viterbi over a window: the longest piece's last places, and those before them from which a path leads there.

        Each place counts the living places that go on from it; one that is too far back to begin a piece and has none dies, and so may the
        one before it. When the first place of the window has one living follower left, all paths have met there: the ids up to it are
        final, and the window starts at it. So a character costs constant work beside its matches. Memory is that of the
        window: a few pieces' length in prose, but linear in a stretch where paths never meet.
        """
        out: list[int] = []
        base = root = 0  # of the lists, and of the window
        score, back, made, alive, followers = [0.0], [0], [-1], [0], [0]  # followers: the sum of the living ones' places
        matches = self.machine.iter(text)
        end, found = next(matches, (len(text), None))
        for i in range(len(text)):
            top, start, piece, single = -np.inf, i, -1, False
            while end == i and found is not None:
                size, s, k = found
                if (total := score[i + 1 - size - base] + s) > top:
                    top, start, piece = total, i + 1 - size, k
                single |= size == 1
                end, found = next(matches, (len(text), None))
            if not single and (total := score[i - base] + self.unknown_score) > top:
                top, start, piece = total, i, -1
            score.append(top)
            back.append(start)
            made.append(piece)
            alive.append(0)
            followers.append(0)
            alive[start - base] += 1
            followers[start - base] += i + 1
            gone = i + 1 - self.longest
            place = gone
            while place > root and place <= gone and not alive[place - base]:
                before = back[place - base]
                alive[before - base] -= 1
                followers[before - base] -= place
                place = before
            while root <= gone and alive[root - base] == 1:
                after = followers[root - base]
                out += [made[after - base]] if made[after - base] >= 0 else self._raw(text[root:after])
                root = after
            if root - base > TRIM:
                for kept in (score, back, made, alive, followers):
                    del kept[: root - base]
                base = root
        return out + self._path(text, back, made, base, root, len(text))

    def _path(self, text: str, back: list[int], made: list[int], base: int, start: int, end: int) -> list[int]:
        ids: list[int] = []
        while end > start:
            before, piece = back[end - base], made[end - base]
            ids += [piece] if piece >= 0 else self._raw(text[before:end])[::-1]
            end = before
        return ids[::-1]

    def _raw(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.replace(LITERAL, SPACE).encode()] if self.lossless else [self.unknown]  # type: ignore[misc]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts from their ids, one after the other, and where each text's end."""
        some = self.spells[ids]  # control pieces spell nothing
        own, ends = ids[some].astype(np.int64), np.concatenate([[0], np.cumsum(some)])[ends]
        first = ends[:-1][ends[:-1] < ends[1:]]
        own[first] += len(self.bytes_of)
        spelled = self.spelled.take(pa.array(own))
        offsets = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset :][: len(own) + 1][ends] if len(own) else np.zeros(len(ends), np.int32)
        data = spelled.buffers()[2] or pa.py_buffer(b"")
        made = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:  # ids that are nobody's encoding may spell no UTF-8
            made = pa.array([x.decode(errors="replace") for x in made.cast(pa.binary(), safe=False).to_pylist()], pa.string())
        return made

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


_coders: dict[bytes, PieceCoder] = {}


def coder(proto: bytes) -> PieceCoder:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(proto).digest()
    if key not in _coders:
        _coders[key] = PieceCoder(proto)
    return _coders[key]


def read_model(path: str = MODEL) -> bytes:
    """A vocabulary file, read on the driver; it is a few hundred kB and goes out with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text. Null and empty texts have no ids. A column named as ``ids_col`` is replaced.

    Rows that repeat another are encoded each and alike. Very long texts are encoded whole, in time linear in their length whatever their
    signs; a stretch of one sign keeps its back pointers until a blank, a line end or another sign lets the paths meet.
    An empty table gives no rows; other columns pass through, whatever their names.
    """
    proto = read_model(model)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        own = coder(proto)

        def work(texts: list[bytes]) -> list[pa.Array]:
            ids, ends = own.encode_all([x.decode() for x in texts])
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))]

        return work

    keep = [c for c in docs.columns if c != ids_col]
    return map_text(docs, keep, text_col, make, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])


def decode_pieces(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of each row's ids; null ids have the text ''. A column named as ``text_col`` is replaced."""
    proto = read_model(model)
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*docs.select(*[named(c) for c in keep]).schema.fields, T.StructField(text_col, T.StringType())])
    source = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(ids_col).alias("ids"))

    def run(batches):
        own = coder(proto)
        for batch in batches:
            for part in slices(batch):
                lists = part.column(len(keep))
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = own.decode_all(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], names=schema.names)

    ship(docs.sparkSession)
    return source.mapInArrow(run, schema)


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_ids, a hash of the ids, the decoded text's SHA-256, and whether it is the text; one row per row of ``docs``.

    Null texts count as empty ones; see ``encode_pieces`` for repeated rows and very long texts. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    coded = encode_pieces(docs.select("doc_id", text.alias("text")), model=model)
    slim = coded.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "ids")
    back = decode_pieces(slim, model=model)
    return back.select(
        "doc_id",
        "n_chars",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"),
    )
