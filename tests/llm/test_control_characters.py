"""Token ids of texts with control characters, against whole-text encoding."""

import numpy as np

from kinlink.llm import queries, tokenstore
from kinlink.llm.common import quiet_tokenizer

TEXTS = ["\x00", "a\x01b", "\x7f", *(f"x {chr(k)} y{chr(k)}z{chr(k)}" for k in range(128)), "".join(map(chr, range(33, 127))), "é\x01 \x7fé", "don't\x02."]


def test_control_characters(spark, tmp_path):
    tok, start, path = quiet_tokenizer(queries.WORDS), 0, f"file://{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), queries.WORDS, 2, path)
    for r in tokenstore.read_documents(spark, path).orderBy("doc_id").collect():
        want = [*tok.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.start) == (r.doc_id, want, start)
        start += len(want)
