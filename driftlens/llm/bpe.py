"""Byte-level BPE encoding and decoding through a sentencepiece model built from the ranks.

The model is written straight from the vocabulary: each token's bytes are mapped to one
character per byte, its score is minus its rank, and normalisation is the identity. Merging
the best-scored pair first is then merging the lowest rank first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Byte b is the character BYTE_BASE + b: letters without case, composition or white space.
BYTE_BASE = 0x4E00
_MAP = {b: chr(BYTE_BASE + b) for b in range(256)}
_TO_BYTE = {BYTE_BASE + b: b for b in range(256)}

#: Encoded pre-tokens that a task remembers; beyond it starts anew, so memory is bounded.
REMEMBERED = 200_000


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def unmapped(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in the order of their ranks 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[k] for k in range(len(ranks))]


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece k is token k; the unknown piece is last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=mapped(token), score=float(-rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = model.trainer_spec
    t.model_type = pb.TrainerSpec.BPE
    t.vocab_size = len(model.pieces)
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(tokens), -1, -1, -1
    n = model.normalizer_spec
    n.name = "identity"
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes whole texts in one task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.pieces = [unmapped(self.sp.id_to_piece(k)) for k in range(self.sp.get_piece_size() - 1)]
        self.whole = {p: k for k, p in enumerate(self.pieces)}
        self.names = [str(k) for k in range(len(self.pieces))]
        self.memory: dict[str, tuple[int, ...]] = {}

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        new = [w for w in dict.fromkeys(words) if w not in memory]
        rest = []
        for w in new:
            k = self.whole.get(w.encode())
            if k is None:
                rest.append(w)
            else:
                memory[w] = (k,)
        if rest:
            for w, ids in zip(rest, self.sp.encode([mapped(w.encode()) for w in rest], num_threads=1)):
                memory[w] = tuple(ids)
        return [memory[w] for w in words]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece_ids in self.ids_of(self.find(text)):
            ids.extend(piece_ids)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every text and the bytes that they decode to, as counts and digests.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space),
    ``decoded_sha256`` and, if ``with_ids``, ``token_ids`` (array<int>). A null text is empty:
    no tokens, both digests of the empty string. Repeated rows give repeated results; a null
    id stays null. The model is built once from the file ``vocabulary`` and broadcast: its
    size is that of the vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(build_model(load_ranks(vocabulary)))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, ids_hash, out_hash, tokens = [], [], [], []
                for text in batch.column(1):
                    ids = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                    out_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        tokens.append(ids)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(out_hash, pa.string())]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
