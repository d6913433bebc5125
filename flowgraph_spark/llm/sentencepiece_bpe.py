"""Merge-type sentencepiece encoding by backtracking over longest matches.

The encoding that merging gives is the only sequence of pieces in which each
piece, and each pair of neighbours, merges back to itself: the merges inside a
stretch of text run in the same order whatever stands around it, so the first
merge across a border would also happen in the pair alone. Hence the encoder
takes the longest piece at each position (all matches come from one
Aho-Corasick pass), checks it against the piece before it by merging the two
again, tries shorter ones, and steps back where none fits. A position it steps
back from can be no border, which a bitfield remembers, so that the time is
linear in the text.
"""

import codecs
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from .common import slices, texts_of

SPACE = "▁"
#: Distinct words, and pairs of pieces, that a worker remembers.
MEMO_WORDS = 500_000
MEMO_PAIRS = 500_000

_MODELS = {}


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


class MergeModel:
    """Pieces of a sentencepiece model of type BPE without text normalisation."""

    def __init__(self, serialized):
        proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != trainer.BPE or normalizer.precompiled_charsmap:
            raise ValueError("Only models of type BPE without a character map are encoded.")
        if normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("Only models that keep and escape white space are encoded.")
        kind = proto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("Models with user-defined or unused pieces are not encoded.")
        library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        self.text, self.score, self.ids, self.bytes_of, self.byte_id = [], [], {}, {}, {}
        for number, piece in enumerate(proto.pieces):
            self.score.append(piece.score)
            if piece.type == kind.NORMAL:
                self.ids[piece.piece] = number
                self.text.append(piece.piece.replace(SPACE, " "))
            elif piece.type == kind.BYTE:
                value = int(piece.piece[1:-1], 16)
                self.bytes_of[number], self.byte_id[value] = value, number
                self.text.append("")
            else:
                self.text.append(trainer.unk_surface if piece.type == kind.UNKNOWN else "")
        self.pieces = {number: piece for piece, number in self.ids.items()}
        self.matcher = ahocorasick.Automaton()
        for piece, number in self.ids.items():
            self.matcher.add_word(piece, (len(piece), number))
        self.matcher.make_automaton()
        # A word is a run of spaces and what follows, unless a piece spans more.
        self.words_apart = not any(
            a != SPACE and b == SPACE for piece in self.ids for a, b in zip(piece, piece[1:])
        )
        self.words, self.whole, self.pairs = {}, {}, {}

    def merge(self, text):
        """Pieces of a short text by merging the best pair until none is left."""
        parts = list(text)
        while True:
            best, place = None, -1
            for k in range(len(parts) - 1):
                number = self.ids.get(parts[k] + parts[k + 1])
                if number is not None and (best is None or self.score[number] > best):
                    best, place = self.score[number], k
            if place < 0:
                return parts
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def _alone(self, piece):
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def _compatible(self, left, right):
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(left + right) == [left, right]
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def backtrack(self, word):
        """Pieces of a word; a character outside the model is a piece of its own."""
        size = len(word)
        matches = [[] for _ in range(size)]  # lengths by start, ascending
        for last, (length, _) in self.matcher.iter(word):
            matches[last - length + 1].append(length)
        for start, lengths in enumerate(matches):
            if not lengths or lengths[0] != 1:
                lengths.insert(0, 1)
        failed = bytearray(size // 8 + 1)
        path, start, choice = [], 0, len(matches[0]) - 1
        while start < size:
            accepted = False
            while choice >= 0:
                end = start + matches[start][choice]
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = word[start:end]
                    if path:
                        before, _ = path[-1]
                        accepted = self._compatible(word[before:start], piece)
                    else:
                        accepted = self._alone(piece)
                    if accepted:
                        break
                choice -= 1
            if accepted:
                path.append((start, choice))
                start = end
                choice = len(matches[start]) - 1 if start < size else -1
            else:
                failed[start >> 3] |= 1 << (start & 7)
                start, choice = path.pop()
                choice -= 1
        borders = [begin for begin, _ in path] + [size]
        return [word[a:b] for a, b in zip(borders, borders[1:])]

    def word_ids(self, word):
        """Ids of a word as little-endian unsigned 32-bit integers."""
        found = []
        for piece in self.backtrack(word):
            number = self.ids.get(piece)
            if number is not None:
                found.append(number)
            elif self.byte_id:
                found.extend(self.byte_id[value] for value in piece.encode("utf-8"))
            else:
                found.append(self.unknown)
        return np.array(found, "<u4").tobytes()

    def _remembered(self, word):
        ids = self.words.get(word)
        if ids is None:
            ids = self.word_ids(SPACE + word)
            if len(self.words) < MEMO_WORDS:
                self.words[word] = ids
        return ids

    def encode(self, text):
        """Ids of a text as bytes, with begin and end ids."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        if not text:
            return begin + end
        plain = self.words_apart and self.prefix and SPACE not in text
        if plain and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
            try:
                body = b"".join(map(self.words.__getitem__, words))
            except KeyError:
                body = b"".join(map(self._remembered, words))
            return begin + body + end
        escaped = self.prefix + text.replace(" ", SPACE)
        if not self.words_apart:
            return begin + self.word_ids(escaped) + end
        # Cut before each run of spaces.
        body, start, size = [], 0, len(escaped)
        while start < size:
            at = start
            while at < size and escaped[at] == SPACE:
                at += 1
            stop = escaped.find(SPACE, at)
            stop = size if stop < 0 else stop
            single = at == start + 1
            body.append(self._remembered(escaped[at:stop]) if single else self.word_ids(escaped[start:stop]))
            start = stop
        return begin + b"".join(body) + end

    def decode(self, ids):
        """Text of ids given as bytes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not self.bytes_of or self.bytes_of.keys().isdisjoint(numbers):
            text = "".join(map(self.text.__getitem__, numbers))
        else:
            parts, run = [], bytearray()
            for number in numbers:
                value = self.bytes_of.get(number)
                if value is not None:
                    run.append(value)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "each-byte"))
                    run = bytearray()
                parts.append(self.text[number])
            parts.append(run.decode("utf-8", "each-byte"))
            text = "".join(parts)
        if not self.prefix:
            return text
        # One space goes where the first piece with text begins with it.
        first = next((n for n in numbers if n not in (self.begin, self.end)), None)
        return text[1:] if first in self.pieces and text[:1] == " " else text


def model_of(serialized):
    """The worker's model, built once."""
    key = hashlib.sha256(serialized).digest()
    if key not in _MODELS:
        _MODELS[key] = MergeModel(serialized)
    return _MODELS[key]


def encode_documents(docs, serialized, digests_only=False):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, with ids and decoded text.

    ``serialized`` is the model file's content, a few hundred kilobytes. Null
    text is empty: its ids are the begin and end ids. Repeated rows are encoded
    each; other columns are not read. ``digests_only`` leaves out ``ids``
    (little-endian unsigned 32-bit integers) and ``decoded``.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string()),
    ]
    fields = fields[:4] if digests_only else fields

    def run(batches):
        model = model_of(serialized)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"])):
                    ids = model.encode(text)
                    decoded = model.decode(ids)
                    rows.append(
                        (
                            doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(decoded.encode("utf-8")).hexdigest(), ids, decoded,
                        )[: len(fields)]
                    )
                columns = list(zip(*rows))
                yield pa.record_batch(
                    [pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not digests_only:
        schema += ", ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
