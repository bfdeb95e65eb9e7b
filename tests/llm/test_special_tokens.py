import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from keyloom.llm import idfile, packing
from keyloom.llm.bpe import ChunkedBpe

BPE = P.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"end {END} go", END, f"a{END}.", f"a {END}, b", f"x\n{END}\ny", f"a  {END}  b", f"{END}{END} a {END} ", "<|endoftext |> <|endoftext|", f"it's{END}'s é{END}日"]


def test_added_tokens_keep_their_ids():
    library, own = Tokenizer.from_file(BPE), ChunkedBpe(BPE, table_limit=500, segment_chars=20)
    assert own.chunked
    random.seed(6)
    texts = TEXTS + ["".join(random.choice([*" \n\tab'sé1!. 日<|", END]) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    got = [np.frombuffer(x, own.dtype).tolist() for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got[0] == [437, 220, 50256, 467]


def test_operators_with_added_tokens(spark):
    library = Tokenizer.from_file(BPE)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = [np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in TEXTS]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    found = idfile.read_id_files(idfile.write_id_files(docs, BPE, 2)).collect()
    assert sorted(map(tuple, found)) == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    for r in packing.pack_documents(docs, BPE, capacity=4).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
