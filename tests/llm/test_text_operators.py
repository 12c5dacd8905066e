"""Packing, codec, token counts, URL filters, chats, secrets and rules: brute force, round trips, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestone.llm import chat_format, packing, piece_codec, quality_rules, queries, secrets, token_counts, url_filter
from lodestone.llm.tokens import PieceIds, shared_ids, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
EDGE = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "s", 0, "x"),
    (3, " \n\t\x0b ", "en", None, 0, None),
    (4, "Héllo, wörld! it's 2024 <|endoftext|> 日本語 \u2028 end", "en", "s", 0, "x"),
    (4, "Héllo, wörld! it's 2024 <|endoftext|> 日本語 \u2028 end", "en", "s", 0, "x"),
    (None, "no id", "de", "s", 5, "x"),
    (6, "word " * 30_000, "en", "t", 0, "x"),
    (7, "x" * 70_000, "en", "t", 0, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_bins(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_equals_one_document_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(1, 300))]
    bins, count = defaultdict(list), Counter()
    for p in packing.best_fit_decreasing(Counter(lengths), capacity):
        count[p.length] += p.each * p.n_bins
        for b in range(p.n_bins):
            bins[p.first_bin + b] += [(p.offset + k * p.length, p.length) for k in range(p.each)]
    assert count == Counter(lengths)
    for places in bins.values():
        ends = [0, *[o + n for o, n in sorted(places)]]
        assert [o for o, _ in sorted(places)] == ends[:-1]
    assert sorted(capacity - sum(n for _, n in x) for x in bins.values()) == brute_bins(lengths, capacity)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = np.array(ids[at : at + 2048], "<u4")
            want[(doc, k, at, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = [0, *[o + n for o, n in sorted(places)]]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) == len(brute_bins([r.length for r in rows], 2048))


def test_packing(spark, small, edge, none):
    rows = queries.op1_best_fit_packing(spark, small).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    check_packing(packing.pack_documents(edge).collect(), [(r[0], r[1]) for r in EDGE])
    assert packing.pack_documents(none).collect() == []


def test_a_plain_word_is_remembered_once_and_forgotten():
    ids = PieceIds(tokenizer_path("word_bpe_49k.json"))
    first = ids.one("alpha beta, alpha")
    assert "alpha" in ids.pieces and "alpha" not in ids.words and "beta" in ids.words
    ids.forget()
    assert not (ids.words or ids.pieces or ids.others or ids.words.older or ids.pieces.older)
    assert ids.one("alpha beta, alpha") == first == np.array(ids.library.encode("alpha beta, alpha", add_special_tokens=False).ids, "<u4").tobytes()


def test_workers_forget_words_after_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(200)
    packing.pack_documents(docs).count()
    path = tokenizer_path("word_bpe_49k.json")

    def kept(batches):
        for b in batches:
            yield b.assign(id=len(shared_ids(path).pieces))

    assert {r[0] for r in spark.range(8, numPartitions=8).mapInPandas(kept, "id long").collect()} == {0}


def test_short_way_equals_the_tokenizer_library():
    rng = random.Random(3)
    ids = PieceIds(tokenizer_path("word_bpe_49k.json"))
    letters = "abcdetrsnoiéläßœÉ'!#9x.,-& \n<|>"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    words += ["It'S DON'T we'LL 'ſ", "İstanbul ŉ ſ", "a<|endoftext|>b", "e\u0301 é", "１２３ ½", "\x1c\x85\xa0x"]
    for word, e in zip(words, ids.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
        assert ids.one(word) == np.array(e.ids, "<u4").tobytes(), word


def test_codec_by_chunks_equals_one_pass():
    pieces, rng = piece_codec.Pieces(tokenizer_path("piece_bpe_32k.model")), random.Random(2)

    def by_chunks(text, size):
        t, m = piece_codec.normal(text), pieces.longest
        cut = [(min(size, len(t) - a), t[a : a + size + m]) for a in range(0, len(t), size)]
        solved = [piece_codec.Solved.of(pieces, c, n) for n, c in cut]
        ends = [n - len(c) + len(x.tail or "") for (n, c), x in zip(cut, solved, strict=True)]
        entry = [np.array([0.0] + [piece_codec.NONE] * (m - 1))]
        for c, e in zip(solved, ends, strict=True):
            entry.append(piece_codec.combine(entry[-1], c.transfer(pieces, e)))
        leave, out = 0, []
        for c, at, e in zip(reversed(solved), reversed(entry[:-1]), reversed(ends), strict=True):
            out.append(c.part(pieces, at, leave, e))
            leave = c.way_back(pieces, at)[leave]
        return b"".join(reversed(out))

    for k in range(150):
        text = "".join(rng.choice("abcdetion  \n▁é梦𝄞hersing" if k % 3 else "abetionhersing") for _ in range(rng.randint(1, 250)))
        whole = piece_codec.normal(text)
        _, back = pieces.forward(whole, {0: 0.0}, len(whole))
        want = np.array(pieces.path(whole, back, len(whole))[1], "<u4").tobytes()
        assert piece_codec.encode(pieces, text) == want
        assert all(by_chunks(text, size) == want for size in (16, 17, 40, 100))
        assert piece_codec.decode(pieces, want) == text.replace("▁", " ")


def test_codec_equals_the_library_reading_the_pieces_as_unigram(small):
    """The model file with its type set to unigram, for texts of known characters and single blanks."""
    import duckdb
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    data = open(path, "rb").read()

    def fields(b):
        at = 0

        def varint():
            nonlocal at
            x = s = 0
            while True:
                c = b[at]
                at += 1
                x |= (c & 127) << s
                s += 7
                if c < 128:
                    return x

        while at < len(b):
            begin, tag = at, varint()
            if tag & 7 == 0:
                varint()
            elif tag & 7 == 2:
                n = varint()
                at += n
            else:
                at += 8 if tag & 7 == 1 else 4
            yield tag >> 3, b[begin:at]

    def size(n):
        out = bytearray()
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def body(x):
        at = 1
        while x[at] >= 128:
            at += 1
        return x[at + 1 :]

    out = b""
    for number, raw in fields(data):
        if number == 2:
            spec = b"".join(x for k, x in fields(body(raw)) if k != 3) + b"\x18\x01"
            raw = b"\x12" + size(len(spec)) + spec
        out += raw
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    pieces, same, n = piece_codec.Pieces(path), 0, 0
    texts = duckdb.sql(f"select text from read_parquet('{small}/documents.parquet') limit 150").fetchall()
    for (text,) in texts:
        for word in set(re.findall(r"[a-z]{2,12}", text)):
            n += 1
            theirs, ours = library.encode(word), np.frombuffer(piece_codec.encode(pieces, word), "<u4").tolist()
            same += theirs == ours
            # never a worse path than the library's; it leaves a few words at one
            assert sum(pieces.score[pieces.text[i]] for i in ours) >= sum(pieces.score[pieces.text[i]] for i in theirs), word
    assert n > 1000 and same >= 0.99 * n


def best_score(points, unknown, text):
    """The best score of a segmentation, from the end of the text to its start."""
    best = [0.0] * (len(text) + 1)
    longest = max(map(len, points))
    for at in range(len(text) - 1, -1, -1):
        ways = [points[text[at:end]] + best[end] for end in range(at + 1, min(len(text), at + longest) + 1) if text[at:end] in points]
        best[at] = max(ways if text[at] in points else [*ways, unknown + best[at + 1]])
    return best[0]


@pytest.mark.parametrize("chunk", [700, piece_codec.CHUNK])
def test_whole_documents_take_the_best_path(spark, tiny, edge, chunk):
    """Against a dynamic programme over the model's pieces that shares nothing with the operator."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    every = range(model.get_piece_size())
    kind = ["byte" if model.is_byte(i) else "" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in every]
    points = {model.id_to_piece(i): model.get_score(i) for i in every if kind[i] == "piece"}
    unknown = min(points.values()) - 10
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").unionByName(edge.where("doc_id < 6").selectExpr("-doc_id AS doc_id", "text"))
    encoded = piece_codec.encode_documents(docs, chunk=chunk)
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.text) for r in piece_codec.decode_documents(encoded).collect()) == want
    texts = {d: t for d, t in want}
    crcs = {str(r.doc_id): r.ids_crc32 for r in piece_codec.codec_report(docs, chunk=chunk).collect()}
    for r in encoded.collect():
        text = texts[str(r.doc_id)]
        marked = "▁" + text.replace(" ", "▁") if text else ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        spelled = b"".join(bytes([int(model.id_to_piece(i)[3:5], 16)]) if kind[i] == "byte" else model.id_to_piece(i).encode() for i in ids)
        assert spelled.decode() == marked
        # of a character's bytes the first has the score
        score = sum(points[model.id_to_piece(i)] if kind[i] == "piece" else unknown * (not 0x80 <= int(model.id_to_piece(i)[3:5], 16) < 0xC0) for i in ids)
        assert score == pytest.approx(best_score(points, unknown, marked), abs=0.5)
        assert crcs[str(r.doc_id)] == zlib.crc32(r.ids)


def test_token_counts_of_the_table_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = sorted((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op4_token_counts(spark, small).collect()) == want


def test_codec_and_token_counts(spark, small, edge, none):
    by_chunks, whole = (sorted((tuple(r) for r in piece_codec.codec_report(edge, chunk=n).collect()), key=str) for n in (1_000, 10**6))
    assert by_chunks == whole and len(whole) == len(EDGE) and all(r[4] for r in whole)
    assert [r for r in whole if r[0] in (1, 2)] == [(1, 0, 0, 0, True), (2, 0, 0, 0, True)]
    assert len([r for r in whole if r[0] == 4]) == 2
    assert piece_codec.codec_report(none).collect() == []
    assert piece_codec.encode_documents(none).collect() == []

    ids = PieceIds(tokenizer_path("word_bpe_49k.json"), special=False)
    want = sorted((str(d), len(ids.one(t or "")) // 4) for d, t, *_ in EDGE)
    for block in (7, 1 << 17):
        stream = token_counts.token_stream(edge, block_ids=block).collect()
        saved = spark.createDataFrame([tuple(r) for r in stream], token_counts.STREAM)
        counted = token_counts.count_tokens(saved.where("data is not null"))
        names = saved.where("ordinal is not null").select("file", "ordinal", "doc_id")
        got = sorted((str(r.doc_id), r.n_tokens) for r in names.join(counted.where("ended"), ["file", "ordinal"]).collect())
        assert got == want
        assert counted.where("not ended").count() == 0
    assert token_counts.document_token_counts(none).collect() == []


def test_flat_files(spark, tmp_path):
    eod = token_counts.SEPARATOR
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 3, eod, eod, 4, eod, 5, 6], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 2, 4, 100):
        blocks = token_counts.read_token_files(spark, str(tmp_path), block_ids=block)
        got = sorted((r.ordinal, r.n_tokens, r.ended) for r in token_counts.count_tokens(blocks).collect())
        assert got == [(0, 3, True), (1, 0, True), (2, 1, True), (3, 2, False)]


def test_url_rules_and_collisions(spark, tmp_path):
    urls = [
        None,
        "",
        "no scheme",
        "http://",
        "HTTPS://WWW.Example.COM/en/7?x",
        "https://example.com/en/8#a",
        "https://notexample.com/en/7",
        "https://x.net/de",
        "https://x.net/de/1",
        "https://a.example.net/de/8",
        "https://spam-farm.example.org",
        "https://x.spam-farm.example.org/q",
        "https://org/es/",
        "x://a.org/es//://b",
    ]
    df = spark.createDataFrame([(i, u, "w") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.judge_urls(df, queries.URL_RULES, queries.URL_HOSTS).select("page_id", "judged.*").orderBy("page_id").collect()]
    assert got == [
        (0, "", "", None, "allow"),
        (1, "", "", None, "allow"),
        (2, "", "", None, "allow"),
        (3, "", "", None, "allow"),
        (4, "www.example.com", "/en/7", "example.com/en/7", "allow"),
        (5, "example.com", "/en/8", "com/en/", "block"),
        (6, "notexample.com", "/en/7", "com/en/", "block"),
        (7, "x.net", "/de", None, "allow"),
        (8, "x.net", "/de/1", "net/de/", "allow"),
        (9, "a.example.net", "/de/8", "example.net/de/8", "block"),
        (10, "spam-farm.example.org", "", None, "block"),
        (11, "x.spam-farm.example.org", "/q", None, "block"),
        (12, "org", "/es/", "org/es/", "block"),
        (13, "a.org", "/es//://b", "org/es/", "block"),
    ]
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).collect() == []
    same = lambda text: 7
    path = str(tmp_path / "c")
    url_filter.write_digest_file([("a.com/x", 1), ("b.com/x", 2), ("é.com", 3)], path, same)
    index = url_filter.DigestFile(path, same)
    assert index.find(["b.com/x", "c.com/x", "é.com", "a.com/x"], (1, 2)).tolist()[1:3] == [-1, -1]
    assert [index.string(i) for i in index.find(["b.com/x", "a.com/x"], (1, 2))] == ["b.com/x", "a.com/x"]


def test_very_long_urls_and_clashing_columns(spark):
    host = ".".join("a" * 60_000) + ".example.com"
    df = spark.createDataFrame([(1, f"http://{host}/en/7/{'x' * 100_000}", "kept"), (2, f"http://{'b.' * 50_000}spam-farm.example.org", "kept")], "page_id long, url string, judged string")
    out = url_filter.judge_urls(df, queries.URL_RULES, queries.URL_HOSTS)
    assert out.columns == ["page_id", "url", "judged", "judged_"]
    got = out.select("page_id", "judged", "judged_.rule", "judged_.verdict", F.length("judged_.host").alias("n")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "kept", "example.com/en/7", "allow", len(host)), (2, "kept", None, "block", 100_021)]


def test_very_long_conversations(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é ### "), F.col("id").cast("string")).alias("text"))
    one_role = rows.withColumn("conv_id", F.lit(2).cast("long")).withColumn("role", F.lit("assistant"))
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.format_chats(rows.unionByName(one_role))).collect()}
    for conv, loss in ((1, [i for i in range(n) if i % 3]), (2, range(n))):
        assert got[conv].n_turns == n
        assert got[conv].loss_sha256 == hashlib.sha256("".join(f"é ### {i}" for i in loss).encode()).hexdigest()


def test_chats_round_trip(spark):
    rng = random.Random(1)
    parts = ["### ", "</turn>", "<+>", "\\", "\\\\", ": ", "\n", "#", "<", "ok", "é𝄞", "/turn>", "turn", "+>", " "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "a: b", "### x"])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))]), 1))
    rows += [(None, 0, "user", "x", 1), (70, None, "user", "first", 1), (70, 0, "user", "b", 1), (70, 0, "user", "a", 1), (70, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chats.select("*", chat_format.parsed_turns(chats.formatted).alias("turns"), chat_format.masked_texts(chats.formatted, chats.loss_spans).alias("loss")).collect()}
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss == [t for r, t in turns if r == "assistant"]
        assert got[conv].formatted.count("</turn>\n") == sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False)) + 1
    digest = {r.conv_id: r for r in chat_format.chat_digest(chats).collect()}
    turns = [(r, t) for *_, r, t in sorted(want[3])]
    assert digest[3].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat_format.format_chats(df.limit(0)).collect() == []


def brute_secrets(text):
    spans = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]


KEY = "aB3xY9zQ7LmN2pR5tV8w"


def test_ownership_of_the_table_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    held, owners = {}, defaultdict(set)
    for doc, text, source in docs:
        base = secrets.base_spans(text)
        held[doc] = [v for *_, v in base], [v for *_, v in secrets.candidate_spans(text, base)]
        for v in [*held[doc][0], *held[doc][1]]:
            owners[v].add(source)
    got = {r.doc_id: (r.n_live, r.n_shared) for r in queries.op9_secret_scans(spark, small).collect()}
    want = {d: (sum(len(owners[v]) == 1 for v in [*b, *x]), sum(len(owners[v]) > 1 for v in [*b, *x])) for d, (b, x) in held.items()}
    assert got == want and sum(a + b for a, b in want.values()) > 20


def test_secrets_of_a_very_long_text(spark):
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n))
    text = " ".join(f"key {token(24)} token={token(9)} {'%032x' % rng.getrandbits(128)} {'%030x' % rng.getrandbits(120)}Zq9" for _ in range(20_000))
    base = secrets.base_spans(text)
    extra = secrets.candidate_spans(text, base)
    assert len(base) > 55_000 and len(extra) > 30_000
    named = [(s, e) for s, k, e, _ in base if k < 2]
    some = rng.sample(extra, 200)
    assert all(not any(s < x[2] and e > x[0] for s, e in named) for x in some)
    clean = secrets.redacted(text, [(s, k, e) for s, k, e, _ in [*base, *extra]])
    assert clean.startswith("key [REDACTED:owned] [REDACTED:assign] [REDACTED:") and not secrets.HEX.search(clean)


def test_secrets(spark, small, none):
    rows = {r.doc_id: r for r in queries.op9_secret_scans(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        base = brute_secrets(r.text)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got.spans.split(",")) | {""}
        assert [got.n_assign, got.n_access, got.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
    texts = [
        (1, "a", f"𝄞 PassWord = 'abcdef1' secret:token: abcdef {KEY}1"),
        (2, "a", "AKIA" + "X" * 16 + " " + "0a" * 12 + " AKIAX"),
        (3, "b", f"see {KEY}2"),
        (4, "c", f"see {KEY}2 api_key:{'e' * 30}"),
        (5, "a", None),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "") for i, s, t in texts], DOCS)
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    assert got[1].spans.split(",")[:-1] == brute_secrets(texts[0][2]) and got[1].spans.split(",")[-1].startswith("owned:")
    assert "owned" not in got[3].spans + got[4].spans and got[5].spans == ""
    clean = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert clean[1].text == "𝄞 [REDACTED:assign]' secret:token: abcdef [REDACTED:owned]"
    assert clean[2].text == "[REDACTED:access] [REDACTED:hex] AKIAX" and clean[2].n_chars == len(clean[2].text)
    assert clean[3].text == texts[2][2] and clean[5].text is None
    assert secrets.redact_secrets(docs).columns == docs.columns
    found = {(r.kind, r.doc_id): r for r in secrets.findings(docs).collect()}
    assert found["owned", 1].live and found["hex", 2].n_owners == 1
    # ownership decides: without the second owner the shared value is live, and a candidate with one becomes a copied example
    alone = {r.doc_id: (r.n_live, r.n_shared) for r in secrets.secret_report(docs.where("source <> 'c'")).collect()}
    assert any((got[k].n_live, got[k].n_shared) != v for k, v in alone.items())
    copied = secrets.secret_report(docs.withColumn("source", F.lit("z")).unionByName(docs)).collect()
    assert not any("owned" in r.spans or r.n_live for r in copied) and any(r.n_shared for r in copied)
    assert secrets.secret_report(none).collect() == [] and secrets.redact_secrets(none).columns == none.columns


def brute_features(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, small, edge, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op10_quality_rules(spark, small).collect()}
    for r in docs.collect():
        f = brute_features(r.text)
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == f
        assert got.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        assert not (got.base_failed and got.kept)
    assert sum(r.kept for r in rows.values()) > 0.9 * sum(not r.base_failed for r in rows.values())
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}
    odd = quality_rules.quality_report(edge).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(r[0]) for r in EDGE)
    assert all(brute_features(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in odd for d, t, *_ in EDGE if d == r.doc_id)
    assert quality_rules.quality_report(none).collect() == [] and quality_rules.quality_filter(none).columns == none.columns
