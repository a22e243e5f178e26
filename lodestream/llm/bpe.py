"""Byte-level BPE: the tokenizers library over Arrow batches, on the vocabulary of a rank file.

Bytes are first mapped to printable characters, so that the library's merges over characters act as
merges over bytes; decoding reverses that table, and a character split between tokens is whole again
once the bytes are joined. A rank file names no merges: every split of a token into two tokens is one,
with the token's own rank, which is how a rank-driven encoder merges.

Cases: a null or empty text has no tokens. A text of any length is one unit of work, as merges never cross
the pieces of the pattern. Ids outside the vocabulary raise when decoded. Repeated rows get equal results, extra columns pass through,
columns called like an added one are replaced, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from lodestream.llm.shared import held, small_batches

#: Texts that the library encodes in one call.
CALL_TEXTS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    """The rank file as it is; the driver reads it and broadcasts it (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        token_of = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        by_rank = sorted(token_of.items(), key=lambda x: x[1])
        self.bytes_of = [b""] * (by_rank[-1][1] + 1 if by_rank else 0)
        for token, rank in by_rank:
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        table = byte_characters()
        spell = lambda token: "".join([table[b] for b in token])
        merges = [
            (spell(token[:i]), spell(token[i:]))
            for token, _ in by_rank
            for i in range(1, len(token))
            if token[:i] in token_of and token[i:] in token_of
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in by_rank}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        found: list[list[int]] = []
        for i in range(0, len(texts), CALL_TEXTS):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts[i : i + CALL_TEXTS]], add_special_tokens=False)]
        return found

    def spans(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each the characters [start, end) of the text it covers; tokens of one split character share it."""
        e = self.tokenizer.encode(text or "", add_special_tokens=False)
        return e.ids, e.offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _codec(ranks: bytes, pattern: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held("bpe", (hash(ranks), pattern), lambda: Codec(ranks, pattern))


def _mapped(df: DataFrame, ranks: bytes, pattern: str, columns: dict[str, pa.DataType], made, added: T.StructType) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in df.schema.fields if f.name not in columns]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            found = made(codec, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(v, t) for v, t in zip(found, columns.values(), strict=True)],
                names=names + list(columns),
            )

    return df.mapInArrow(run, T.StructType(kept + added.fields))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """df with ``token_ids``; with ``offsets`` also ``token_starts`` and ``token_ends`` in characters. Columns of those names are replaced."""
    ints = T.ArrayType(T.IntegerType(), False)
    columns = {n: pa.list_(pa.int32()) for n in ("token_ids", *(("token_starts", "token_ends") if offsets else ()))}

    def made(codec: Codec, batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        if not offsets:
            return (codec.encode(texts),)
        found = [codec.spans(t) for t in texts]
        return [i for i, _ in found], [[a for a, _ in o] for _, o in found], [[b for _, b in o] for _, o in found]

    return _mapped(df, ranks, pattern, columns, made, T.StructType([T.StructField(n, ints, False) for n in columns]))


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """df with ``decoded`` (binary) and ``decoded_text`` (bytes that are no UTF-8, as of half a character, become U+FFFD)."""
    columns = {"decoded": pa.binary(), "decoded_text": pa.string()}

    def made(codec: Codec, batch: pa.RecordBatch):
        found = [codec.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        return found, [b.decode("utf-8", "replace") for b in found]

    return _mapped(df, ranks, pattern, columns, made, T.StructType([T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]))


def digests(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """df's other columns with n_tokens and the SHA-256 of the ids and of the decoded bytes: encoding and decoding in one pass."""
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    small = df.withColumnRenamed(text, "bpe_text") if text in columns else df
    source = "bpe_text" if text in columns else text

    def made(codec: Codec, batch: pa.RecordBatch):
        ids = codec.encode(batch.column(batch.schema.get_field_index(source)).to_pylist())
        name = codec.decimal
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [len(x) for x in ids], [sha(",".join([name[i] for i in x]).encode()) for x in ids], [sha(codec.decode(x)) for x in ids]

    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _mapped(small, ranks, pattern, columns, made, added).drop(source)


def default_vocabulary() -> tuple[bytes, str]:
    """The many-language rank file of the public vocabularies, and their pattern."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def documents_digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    ranks, pattern = default_vocabulary()
    return digests(documents.select("doc_id", "text"), ranks, pattern)
