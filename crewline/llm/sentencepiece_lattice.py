"""SentencePiece encoding and decoding as a relational lattice with a Viterbi fold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(name: str = DEFAULT_MODEL) -> str:
    """A public model file of this machine; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The piece table of a model: text, id and score; the ids of the byte pieces; the longest piece in characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        own = [i for i in every if i not in special and not model.is_byte(i)]
        self.rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in own]
        self.longest = max(len(text) for text, _, _ in self.rows)
        self.unknown = min(score for _, _, score in self.rows) - 10.0
        crossing = {b for text, _, _ in self.rows for a, b in zip(text, text[1:]) if re.match(r"\w", a) and not re.match(r"\w", b)} - {SPACE}
        # No piece crosses a line end, a blank behind a run, or the border of a letter and a sign, but for these signs.
        sign = f"[^\\w{SPACE}\\n]"
        over = f"(?:[{''.join(re.escape(c) for c in sorted(crossing))}]{sign}*)?" if crossing else ""
        self.stretch = f"{SPACE}*\\n|{SPACE}*{sign}*(?:\\w+{over})+|{SPACE}*{sign}+|{SPACE}+"
        if any("\n" in text or SPACE in text.lstrip(SPACE) for text, _, _ in self.rows):
            raise ValueError("a piece crosses a line end or a blank")
        spelled = {i: text.encode() for text, i, _ in self.rows} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [spelled.get(i, b"") for i in every]
        self.hex = [text.hex() for text in self.spelled]
        # The piece table by beginnings: number of a beginning and the next character -> number of the longer one; 0 is the empty one.
        steps: dict[tuple[int, str], int] = {}
        whole: dict[int, tuple[int, float]] = {}
        for text, i, score in self.rows:
            at = 0
            for c in text:
                at = steps.setdefault((at, c), len(steps) + 1)
            whole[at] = (i, score)
        found = sorted((at << 21 | ord(c), to) for (at, c), to in steps.items())
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*found))
        self.id = np.array([whole.get(at, (-1, 0.0))[0] for at in range(len(steps) + 1)], np.int32)
        self.score = np.array([whole.get(at, (-1, -np.inf))[1] for at in range(len(steps) + 1)])


class _Coded:
    """Distinct words and their ids: number of each word, and the ids of all words one after another."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.number: dict[str, int] = {}
        self.first, self.size, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def add(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        words = sorted(words, key=len, reverse=True)
        size, ids = _best_paths(words, self.pieces)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        ends = np.cumsum(size)
        # Each word is decoded once; a text is its words one after another.
        spelled = self.pieces.spelled
        width = np.concatenate([[0], np.cumsum([len(spelled[i]) for i in ids.tolist()], dtype=np.int64)])
        back, cuts = b"".join([spelled[i] for i in ids.tolist()]), width[np.concatenate([[0], ends])].tolist()
        self.same = np.concatenate([self.same, [back[a:b] == word.encode() for a, b, word in zip(cuts, cuts[1:], words)]])
        self.first = np.concatenate([self.first, len(self.ids) + ends - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])


def _best_paths(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of words in falling order of length the numbers of ids on their best paths, and the ids.

    One lattice for all words, by the place where edges end. At each place the substrings that end there, by their starts, are joined to
    the piece table; the edges are folded into the best score of each word at that place, ties to the smaller start.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    # Words that reach a place are the first ones.
    reach = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    starts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each start its best scores, the words alive and their beginnings
    best, came, through = np.zeros(len(words)), [], []
    for end, n in enumerate(reach.tolist(), 1):
        code = codes[begin[:n] + end - 1]
        starts = [*starts[-(pieces.longest - 1) :], (best, np.arange(len(best)), np.zeros(len(best), np.int64))]
        best, length, ids = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k, (score, alive, state) in enumerate(starts):
            if len(alive) and alive[-1] >= n:
                alive, state = alive[: np.searchsorted(alive, n)], state[: np.searchsorted(alive, n)]
            key = state << 21 | code[alive]
            at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            hit = np.flatnonzero(pieces.keys[at] == key)
            alive, state = alive[hit], pieces.next[at[hit]]
            starts[k] = (score, alive, state)
            reached = score[alive] + pieces.score[state]
            better = np.flatnonzero(reached > best[alive])
            own = alive[better]
            best[own], length[own], ids[own] = reached[better], len(starts) - k, pieces.id[state[better]]
        # A character without a piece is an edge of its own.
        lone = np.ones(n, bool)
        score, alive, state = starts[-1]
        lone[alive[pieces.id[state] >= 0]] = False
        lone = np.flatnonzero(lone & (score[:n] + pieces.unknown > best))
        best[lone], length[lone], ids[lone] = score[lone] + pieces.unknown, 1, -1 - code[lone]
        came.append(length)
        through.append(ids)
    return _read_back(lengths, reach, np.concatenate(came), np.concatenate(through), pieces)


def _read_back(lengths: np.ndarray, reach: np.ndarray, came: np.ndarray, through: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids along the best paths, read from their ends; a character without a piece gives its bytes."""
    level = np.concatenate([[0], np.cumsum(reach)])
    word, place, steps = np.arange(len(lengths)), lengths.copy(), []
    while len(word):
        at = level[place - 1] + word
        steps.append((word, through[at]))
        place = place - came[at]
        word, place = word[place > 0], place[place > 0]
    size = np.zeros(len(lengths), np.int64)
    for own, _ in steps:
        size[own] += 1
    last, ids = np.cumsum(size) - 1, np.zeros(size.sum(), np.int32)
    for k, (own, found) in enumerate(steps):
        ids[last[own] - k] = found
    if (ids >= 0).all():
        return size, ids
    chars, which = np.unique(ids[ids < 0], return_inverse=True)
    spelled = [[pieces.bytes[b] for b in chr(-1 - c).encode()] for c in chars.tolist()]
    width = np.ones(len(ids), np.int64)
    width[ids < 0] = np.array([len(x) for x in spelled])[which]
    to = np.cumsum(width) - width
    out = np.repeat(ids, width)
    lone = to[ids < 0]
    for k in range(max(len(x) for x in spelled)):
        longer = np.array([len(x) > k for x in spelled])[which]
        out[lone[longer] + k] = np.array([x[k] if len(x) > k else 0 for x in spelled], np.int32)[which[longer]]
    return np.add.reduceat(width, last - size + 1), out


def encode(documents: DataFrame, pieces: Pieces, text: str = "text", chars: int = 1 << 20, words: int = 1 << 18) -> DataFrame:
    """``doc_id, ids, exact``: the piece ids of each whole text of ``documents``, and whether they decode to it.

    Blanks are written as U+2581, one is put in front, nothing else is normalised. The segmentation is the path of
    the highest sum of piece scores (ties: the longer last piece); characters outside the pieces fall back to bytes.

    Nothing is shuffled: a text is encoded where it is read. Texts of about ``chars`` characters at a time are cut into stretches that no piece
    crosses, and each distinct one is taken once: its substrings are joined to the piece table (bounded by the model) and the edges
    folded, for all stretches place by place in columns. Their ids are kept for later texts until ``words`` stretches are known.

    An empty or null text has no ids. Repeated rows are encoded alike; an empty table stays empty.
    """
    split = re.compile(pieces.stretch).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Coded(pieces)
        for batch in batches:
            texts, first = batch.column(1), 0
            while first < len(texts):
                found, counts, taken = [], [], 0
                while first + len(counts) < len(texts) and (not counts or taken < chars):
                    one = texts[first + len(counts)].as_py() or ""
                    own = split(SPACE + one.replace(" ", SPACE)) if one else []
                    found += own
                    counts.append(len(own))
                    taken += len(one)
                if len(known.number) > words:
                    known = _Coded(pieces)
                fresh = set(found).difference(known.number)
                if fresh:
                    known.add(list(fresh))
                numbers = np.fromiter(map(known.number.__getitem__, found), np.int64, len(found))
                size = known.size[numbers]
                ends = np.concatenate([[0], np.cumsum(size)])
                ids = known.ids[np.repeat(known.first[numbers] - ends[:-1], size) + np.arange(ends[-1])]
                cuts = np.concatenate([[0], np.cumsum(counts)])
                wrong = np.concatenate([[0], np.cumsum(~known.same[numbers])])[cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        pa.ListArray.from_arrays(pa.array(ends[cuts], pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(wrong[1:] == wrong[:-1]),
                    ],
                    ["doc_id", "ids", "exact"],
                )
                first += len(counts)

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return documents.select("doc_id", F.col(text)).mapInArrow(run, schema)


def _spelled(ids: Column, pieces: Pieces) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(F.lit(pieces.hex), i)), "")), "UTF-8")


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of piece ids: pieces and bytes are put together and read as UTF-8, U+2581 becomes a blank, the one in front goes."""
    joined = F.replace(_spelled(ids, pieces), F.lit(SPACE), F.lit(" "))
    return F.substring(joined, F.lit(2), F.greatest(F.length(joined) - 1, F.lit(0)))
