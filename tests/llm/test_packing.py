import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from eventide.llm import packing
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    texts = ["Hello, world. don't STOP...now", "Größe süß, élan. ÉCOLE 日本語\u00a0x\u2028y", "", "a\x1cb e\u0301 İstanbul ﬁ 12,5 <|endoftext|>", "x" * 500, "they're we'll 's"]
    for text in texts:
        ids = np.frombuffer(packing.encoder(PATH).encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    df = awkward(spark)
    got = packing.pack(df, PATH, length=64, group_size=40).toPandas()
    whole = Tokenizer.from_file(PATH)
    ids = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    assert got["length"].sum() == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
    for r in got.itertuples():
        own = ids[None if np.isnan(r.doc_id) else int(r.doc_id)]
        part = own[r.start : r.start + r.length]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 64
    assert packing.pack(empty(spark), PATH).count() == 0


def test_first_fit_decreasing():
    sizes = np.random.default_rng(0).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert (bins == want).all() and (offsets + sizes <= 100).all()
