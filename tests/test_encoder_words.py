"""Words that are hashed once."""

from rankloom.operators import encode


def test_encoder_hashes_a_word_once(monkeypatch):
    given, plain = [], encode.xxhash.xxh64_intdigest
    monkeypatch.setattr(encode.xxhash, "xxh64_intdigest", lambda piece, seed: given.append(piece) or plain(piece, seed))
    encoder = encode.HashingEncoder()
    first = encoder(["red ring red"])
    assert (encoder(["ring red red"] * 50) == first).all() and len(given) == 9
    small = encode.HashingEncoder(words=1)  # forgets its words and gives the same
    assert (small(["ring red red", "red", "red ring red"]) == encode.HashingEncoder()(["ring red red", "red", "red ring red"])).all()


def test_encoder_reads_whole_texts(spark):
    texts = [" ".join(f"w{i % 700}" for i in range(n)) for n in (512, 513, 5000)]
    words = encode.HashingEncoder()
    plain = [sum(words([w])[0] for w in t.split()) for t in texts]
    small = encode.HashingEncoder(words=3)  # forgets its words within a text
    assert (words(texts) == plain).all() and (small(texts) == plain).all() and len(small.rows) == 3 + encode.WORDS
    head, tail = "red ring " * 400, "cold plate " * 100
    found = {r["id"]: r["vector"] for r in encode.encoded(spark.createDataFrame([(1, head), (2, head + tail)], "id long, query string")).collect()}
    assert found[1] != found[2]
