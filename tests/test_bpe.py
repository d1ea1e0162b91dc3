"""Byte-pair tokens against a reference that goes by characters and bytes."""

import pytest

from turnframe.operators import bpe

tokenizers = pytest.importorskip("public_tokenizers")
SEGS = "conv_id long, msg_idx int, seg_idx int, kind string, text string, owner int, sampled boolean, content_from int, content_to int"
BODIES = ["plain words here", "naïve Ünïcode — 日本語のテキスト 🙂🙃👩‍👩‍👧", " leading space\n\n", "\n", "", "<|endoftext|> as text", "é́ ab c‍", "𝔘𝔫𝔦" * 40]


def rows():
    out = [(0, 0, 0, "S", "<|im_start|>", 0, False, 0, 0)]
    for k, body in enumerate(BODIES):
        head, tail = "user\n" if k % 2 else "<u>", "</u>" if k % 3 else ""
        out.append((0, k, 1, "T", head + body + tail, k, k % 4 == 3, len(head), len(head) + len(body)))
    return out


def reference(row, offsets, overlap):
    """content of each token by the characters that its bytes belong to."""
    *_, sampled, lo, hi = row
    body = [lo <= c < hi for c in range(len(row[4]))]
    return [sampled or (any(body[s:e]) if overlap and e > s else body[s]) for s, e in offsets]


def by_bytes(text, pieces):
    """(start, end) of tokens, from their bytes."""
    of = [c for c, x in enumerate(text) for _ in x.encode()]
    at, out = 0, []
    for p in pieces:
        out.append((of[at], of[at + len(p) - 1] + 1))
        at += len(p)
    assert at == len(of)
    return out


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("file,offsets", [("byte_bpe_50k.json", "native"), ("byte_bpe_50k.json", "decode"), ("byte_bpe_multi_50k.tiktoken", "decode")])
def test_owners_and_content(spark, file, offsets, overlap):
    import base64

    segs = spark.createDataFrame(rows(), SEGS)
    path = tokenizers.path(file)
    got = {}
    for r in bpe.attribute_segments(segs, path, tokenizers.PATTERN, offsets, overlap).orderBy("pos").collect():
        got.setdefault((r["msg_idx"], r["seg_idx"]), []).append(r)
    with open(tokenizers.path("byte_bpe_50k.tiktoken" if file.endswith("json") else file), "rb") as f:
        names = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    for row in rows():
        found = got.get((row[1], row[2]), [])
        if row[3] == "S":
            assert len(found) == 1 and found[0]["token_id"] >= 50_256 and found[0]["owner"] == 0
            continue
        places = by_bytes(row[4], [names[r["token_id"]] for r in found])
        if not overlap:
            assert [r["start"] for r in found] == [s for s, _ in places]
            assert [r["content"] for r in found] == reference(row, places, False)
        elif row[4].isascii():
            assert [r["content"] for r in found] == reference(row, places, True)
        assert {r["owner"] for r in found} <= {row[5]}


def test_unknown_offsets_leave_content_open(spark):
    segs = spark.createDataFrame(rows(), SEGS)
    run = lambda o: bpe.attribute_segments(segs, tokenizers.path("byte_bpe_50k.json"), None, o).orderBy("pos").collect()
    known, open_ = run("native"), run("none")
    assert [r["token_id"] for r in known] == [r["token_id"] for r in open_]
    assert all(r["content"] is None for r in open_ if r["seg_idx"] == 1)


def test_decoding_that_does_not_give_the_text_gives_no_offsets():
    assert bpe.inferred_offsets(lambda ids: "ab"[: len(ids)], [1, 2], "ax") is None
    assert bpe.inferred_offsets(lambda ids: "".join(map(chr, ids)), [97, 98], "ab") == [(0, 1), (1, 2)]
    assert bpe.inferred_offsets(lambda ids: "", [], "") == []


def test_tokens_come_in_batches_of_bounded_size():
    import pyarrow as pa

    texts = ["a b c d e f g h " * 400] * 60 + [""]
    columns = [pa.array(range(len(texts)), pa.int64()), *[pa.array([0] * len(texts), pa.int32())] * 2, pa.array(["T"] * len(texts)), pa.array(texts), pa.array([1] * len(texts), pa.int64())]
    encode = bpe._encoder(tokenizers.path("byte_bpe_50k.json"), None, "native")
    batches = list(encode(iter([pa.RecordBatch.from_arrays(columns, names=list("abcdef"))])))
    sizes = [len(b.column(3).flatten()) for b in batches]
    assert sum(sizes) > 2 * bpe.BATCH_TOKENS and max(sizes) < bpe.BATCH_TOKENS + 4000
    assert [i for b in batches for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert len(batches[-1].column(3)[-1]) == 0
