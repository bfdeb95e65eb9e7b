"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sub_batches

_RUN = re.compile(r" +[^ ]*")


class ChunkedPiece:
    """Encodes with a SentencePiece model, each distinct word with its white-space marks segmented once.

    That holds where no piece has a mark after another character, text isn't changed by the normaliser but for marks,
    and unknown characters fall back to bytes; the constructor looks, and other models get whole texts.
    ``table_limit`` bounds the words kept; beyond it the table starts anew, which only costs time.
    """

    def __init__(self, path: str, table_limit: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "  a  b\tc\nﬁ Å é  "
        self.chunked = not any(re.search("[^▁]▁", x) for x in pieces) and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁") and any(map(self.model.is_byte, range(len(pieces))))
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        mark = self.model.piece_to_id("▁")
        self.chunked = self.chunked and mark != self.model.unk_id()
        # a mark alone can't be asked for: the model sets one before every text, and none before an empty one
        self.alone = {"": np.array([mark], self.dtype).tobytes()}
        self.table, self.table_limit = dict(self.alone), table_limit

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without the one mark that starts each of them; a text that isn't empty gets a mark in front."""
        text = text.replace("▁", " ")
        words = text.split(" ")
        if "" in words:
            return [x[1:] for x in _RUN.findall(" " + text)] if text else []
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids without begin and end, as little-endian bytes of ``dtype``."""
        if not self.chunked:
            return [np.array(x, self.dtype).tobytes() for x in self.model.encode(texts, num_threads=1)]
        cut = [self.words(x) for x in texts]
        new = set().union(*cut).difference(self.table)
        if len(self.table) + len(new) > self.table_limit:
            self.table = dict(self.alone)
            new = set().union(*cut).difference(self.alone)
        new = list(new)
        self.table.update((x, np.array(ids, self.dtype).tobytes()) for x, ids in zip(new, self.model.encode(new, num_threads=1)))
        return [b"".join(map(self.table.__getitem__, x)) for x in cut]


@functools.cache
def worker_piece(path: str) -> ChunkedPiece:
    return ChunkedPiece(path)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Every whole text (null: empty) encoded with begin and end ids and decoded again, without a shuffle.

    Texts of any length are taken in batches of bounded size, a longer one by itself; other columns are ignored; no rows give
    none. Returns doc_id (nulls and repeats stay), n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256.
    """

    def run(batches):
        coder = worker_piece(model)
        begin, end = (np.array([x()], "<u4") for x in (coder.model.bos_id, coder.model.eos_id))
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for rows, texts in sub_batches(batch, "text", 500_000):
                ids = [np.concatenate([begin, np.frombuffer(x, coder.dtype).astype("<u4"), end]) for x in coder.encode(texts)]
                back = coder.model.decode([x.tolist() for x in ids], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows)), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
