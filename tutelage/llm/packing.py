"""Concatenate and cut: all documents' ids in one line, cut into sequences of equal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.tokens import flat_ids, token_table, tokenizer, with_offsets
from tutelage.session import stored


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 1024, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Every text's ids and the end id follow each other in the order of the input partitions; that
    line is cut every ``length`` ids, so all sequences but the last are full and need no padding.
    A piece is what one document has in one sequence: ``start`` counts its document's ids before
    it, ``offset`` its place in the sequence, ``ids`` are little-endian unsigned 32-bit ids.

    Two passes: the first encodes, counts within partitions and writes the ids; the totals of
    the partitions give the global offsets; the second reads the ids and cuts.  No
    document is shuffled.  A null or empty text is the end id alone.  Rows that repeat an id
    are packed one by one, a null id stays null.  No rows give no pieces; other columns are
    not returned.
    """
    table = stored(token_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                               tokenizer_path, end_id=end_id), "tokens", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tokenizer(tokenizer_path).dtype.itemsize
        for batch in batches:
            for at in range(0, len(batch), 1000):
                own = batch.slice(at, 1000)
                ids, edges = flat_ids(own.column("ids"), width)
                start = own.column("start").to_numpy()
                size = np.diff(edges)
                first = start // length
                count = (start + size - 1) // length - first + 1
                doc = np.repeat(np.arange(len(own)), count)
                ends = np.cumsum(count)
                sequence = first[doc] + np.arange(len(doc)) - (ends - count)[doc]
                low = np.maximum(sequence * length, start[doc])
                high = np.minimum((sequence + 1) * length, (start + size)[doc])
                cuts = np.concatenate([[0], np.cumsum(high - low)]) * 4
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_id").take(pa.array(doc)), pa.array(low - start[doc]), pa.array(high - low),
                    pa.array(size[doc]), pa.array(sequence), pa.array(low - sequence * length),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [
                        None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()),
                ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return with_offsets(table).select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
