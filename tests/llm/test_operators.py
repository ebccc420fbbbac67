"""Each operator against a brute-force version, on awkward rows: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caravan.llm import balanced_shards, bottomk, chat, decontaminate, license_scan, paragraph_dedup, quality_rules, sentencepiece_offsets, sstable, warc
from caravan.llm import words as W
from caravan.llm.components import connected_components
from caravan.llm.shared import work_dir

DOCS = "doc_id long, text string, extra int"
PASSAGE = " ".join(f"passage{i} of word{i * 7 % 13}" for i in range(30))
LONG = " ".join(f"long{i % 997}x{i}" for i in range(60_000))


def awkward():
    rows = [(1, "One two three four five. Six!\n\nOne two", 0), (2, None, 1), (3, "", 2), (4, " \t\n ", 3), (5, "it's Ünïcode <|endoftext|> \x1c １２ é́", 4), (6, LONG, 5)]
    rows += [(7, "same text here", 6), (8, "same text here", 7), (8, "same text here", 7), (None, "no id at all", 8), (-9, "negative id \\ </s> [INST] <|im_end|>", 9)]
    base = [f"w{i}" for i in range(80)]
    rows += [(20 + i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]]), i) for i in range(6)]
    own = lambda i, k: " ".join(f"own{i}x{j}" for j in range(k))
    rows += [(40, f"{own(40, 50)} {PASSAGE} {own(4, 50)}", 1), (41, f"{own(41, 50)} {PASSAGE} {own(5, 50)} end", 1), (42, "x y z", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    text = (LONG.encode() if block > 1 else b" a bc") + b" " + b"q" * 5000 + b" end"
    starts, ends, whole = W.word_hashes(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    assert len(set(whole.tolist())) == len(set(text.split()))
    assert not len(W.word_hashes(b"")[2]) and not len(W.word_hashes(b"   ")[2])


def test_long_words_of_a_pattern_do_not_collide():
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    a, b = bytes(97 + x for x in bits), bytes(98 - x for x in bits)
    assert len(set(W.word_hashes(a + b" " + b + b" " + a[:1024] + b" " + b[:1024] + b" a a\0 " + a[:16] + b" " + b[:16])[2].tolist())) == 8


def test_token_shards(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = work_dir(spark, "t")
    sstable.write_shards(docs, folder, path, end_id=1)
    rows = sstable.read_shards(spark, folder).orderBy("start").collect()
    tool = Tokenizer.from_file(path)
    order = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = [[*tool.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in order]
    assert [r.doc_id for r in rows] == [r[0] for r in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    from caravan.llm.shared import storage

    fs, root = storage(folder)
    import json

    found = [sstable.Reader(fs, storage(x["path"])[1]).get(8) for x in json.loads(fs.open_input_stream(f"{root}/manifest.json").read())["files"]]
    assert sum(map(len, found)) == 2
    assert not any(len(sstable.Reader(fs, storage(x["path"])[1]).get(777)) for x in json.loads(fs.open_input_stream(f"{root}/manifest.json").read())["files"])
    none = work_dir(spark, "t")
    assert sstable.write_shards(empty, none, path) == [] and sstable.read_shards(spark, none).count() == 0


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, empty):
    more = spark.createDataFrame([(100, "a b c a b c d\na b c\nx\n\nx", 0), (101, "spam " * 300, 0), (102, "a b", 0), (103, "# $ a|b", 0)], DOCS)
    rows = quality_rules.with_statistics(docs.unionByName(more)).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text) for r in rows)
    good = [(i, " ".join(f"g{i}w{j}" for j in range(60 + i % 7)), 0) for i in range(150)]
    bad = [(1000 + i, " ".join(f"b{i}w{j} ###" for j in range(60)), 0) for i in range(150)]
    labelled = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(good + bad, DOCS)
    rules = quality_rules.fit(table, labelled)
    assert rules.rules and {r.doc_id for r in quality_rules.keep(table, rules).collect()} == {r[0] for r in good}
    clash = table.limit(3).withColumns({"kept": F.lit("mine"), "rule": F.lit(7), "n_words": F.lit("x")})
    assert {(r.kept, r.rule, r.n_words > 50) for r in quality_rules.judge(clash, quality_rules.DecisionList([])).collect()} == {(True, None, True)}
    assert quality_rules.keep(clash, quality_rules.DecisionList([])).first().kept == "mine"
    assert quality_rules.fit(empty, labelled).rules == [] and quality_rules.judge(empty, rules).count() == 0


def test_balanced_shards(spark, empty):
    rows = [(i, f"group {i % 40}" if i < 400 else f"alone {i}", 0) for i in range(1000)] + [(5000 + i, "hot", 0) for i in range(500)] + [(None, None, 0)]
    found = balanced_shards.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in found)
    spread = {g: {r.shard for r in found if text[r.doc_id] == f"group {g}"} for g in range(40)}
    assert sum(len(x) for x in spread.values()) < 80  # ten random members of a group would be in over eight shards
    assert balanced_shards.shard_documents(empty).count() == 0


def test_balanced_shards_do_not_depend_on_the_layout(spark):
    rows = [(i % 3000, f"group {i % 160}" if i < 1500 else f"alone {i}", 0) for i in range(4000)] + [(None, None, 0)] * 3
    tables = [spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame(rows[::-1], DOCS).repartition(9)]
    found = [sorted(map(tuple, balanced_shards.shard_documents(t, shards=6).collect()), key=repr) for t in tables]
    assert found[0] == found[1]


def test_rounds_cut_fewer_edges(spark):
    members = spark.createDataFrame([(i, i // 9) for i in range(900)] + [(i, 1000 + i % 50) for i in range(0, 900, 30)], "node long, group long")
    start = spark.createDataFrame([(i, i * 7 % 5) for i in range(900)], "node long, shard int")
    cut = lambda state: balanced_shards.cut_edges(balanced_shards.group_counts(members, state))
    shard = {i: i * 7 % 5 for i in range(900)}
    groups = {}
    for r in members.collect():
        groups.setdefault(r.group, []).append(shard[r.node])
    assert cut(start) == sum(a != b for g in groups.values() for k, a in enumerate(g) for b in g[:k])
    assert cut(balanced_shards.propagate(members, start, [180] * 5)) < 0.6 * cut(start)


def test_balanced_shards_without_room(spark):
    # every node is linked, several movers share a hash class, and the shards are full: moves are exchanges to the row
    nodes = [(i, i // 8, int(hashlib.md5(b"%d" % i).hexdigest(), 16) % 2) for i in range(24_000)]
    held = Counter(s for _, _, s in nodes)
    members = spark.createDataFrame([(i, g) for i, g, _ in nodes], "node long, group long")
    start = spark.createDataFrame([(i, s) for i, _, s in nodes], "node long, shard int")
    found = {r.node: r.shard for r in balanced_shards.propagate(members, start, [held[s] for s in range(2)]).collect()}
    assert len(found) == len(nodes) and Counter(found.values()) == held
    spread = lambda at: sum(len({at[i] for i in range(g, g + 8)}) for g in range(0, 24_000, 8))
    assert spread(found) < 1.3 * 3000 < spread({i: s for i, _, s in nodes})


def test_warc_round_trip(spark):
    big, small = "é" * 100, "tiny"
    rows = [(3, "http://c", big), (1, "http://a", big), (2, None, big), (4, "x\r\ny", small), (5, "u", small), (6, "u", None), (None, "u", big), (7, "u", ""), (8, "u", "z" * 5000)]
    folder = work_dir(spark, "w")
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, file_bytes=400)
    found = {r.page_id: r for r in warc.read_warc(spark, folder).collect()}
    assert sum(f["records"] for f in files) == len(rows) == len(found)
    for page, _, html in rows:
        data = (html or "").encode()
        assert found[page].payload_bytes == len(data) and found[page].payload_digest == hashlib.sha256(data).hexdigest()
        assert (found[page].record_type, found[page].refers_to) == (("revisit", 1) if page in (2, 3) else ("response", None))
    again = work_dir(spark, "w")
    assert [f["sha256"] for f in warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), again, file_bytes=400)] == [f["sha256"] for f in files]
    none = work_dir(spark, "w")
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), none) == [] and warc.read_warc(spark, none).count() == 0


def test_warc_bytes_do_not_depend_on_the_layout(spark):
    rows = [(i * 37 % 6000 - 50, f"http://{i % 7}", f"page {i % 900} " * (3 + i % 29)) for i in range(6000)] + [(None, None, f"none {i % 30} " * 20) for i in range(600)] + [(7, "u", "hot " * 900 + str(i)) for i in range(80)] + [(7, "u", "hot")] * 3
    hashes, ids = [], []
    for parts in (2, 9):
        folder = work_dir(spark, "w")
        shuffled = spark.createDataFrame(rows[::-1] if parts == 9 else rows, "page_id long, url string, html string").repartition(parts)
        files = warc.write_warc(shuffled, folder, file_bytes=20_000, part_bytes=60_000)
        hashes.append([(f["name"], f["sha256"]) for f in files])
        assert len(files) > 20 and sum(f["records"] for f in files) == len(rows)
        from caravan.llm.shared import storage

        fs, root = storage(folder)
        last = None
        for f in files:
            with fs.open_input_stream(f"{root}/{f['name']}", compression=None) as stream:
                for data in warc.read_members(stream):
                    fields, _, _ = warc.parse(data)
                    ids.append(fields["WARC-Record-ID"])
                    at = int(fields["X-Page"] or -(2**63))
                    assert last is None or at >= last
                    last = at
        assert len(set(ids)) == len(rows)
    assert hashes[0] == hashes[1]


def test_chat_counts_late_events(spark):
    schema = "conv_id long, seq long, message_id long, step long, kind string, role string, text string"
    log = [(1, i, i, 0, "delta", "user" if i % 2 else "assistant", f"message {i}") for i in range(12)]
    late = [(1, 50, 0, 0, "delta", None, " and more"), (1, 51, 3, 0, "edit", None, "edited"), (1, 52, 77, 0, "edit", None, "of nothing"), (1, 53, 9, 0, "regenerate", None, None), (1, 54, 9, 0, "delta", None, "again"), (1, 55, 11, 0, "delta", "user", "reopened"), (None, None, None, None, "delta", None, None), (1, 60, 1, 0, "noise", "x", "y")]
    found = {r.conv_id: r for r in chat.format_events(spark.createDataFrame(log + late, schema)).collect()}
    want = [("user" if i % 2 else "assistant", f"message {i}") for i in range(9)] + [("user", "again"), ("user", "reopened")]
    want[0], want[3] = ("assistant", "message 0 and more"), ("user", "edited")
    assert [(r, t) for r, t, _, _ in chat.parse(found[1].formatted)] == want
    assert [(r, t) for r, t, _, _ in chat.parse(found[None].formatted)] == [("", "")]


def brute_chat(rows):
    """The digests of conversations from their turns, without a log."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        texts = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in texts if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
        out[conv] = (len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_chat_query_against_brute_force(spark, parts):
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], f"turn {t} of {c} </s>[INST]<|im_end|> é " * (1 + (c * t) % 40)) for c in range(40) for t in range(c % 9)]
    rows += [(100, 0, None, None), (100, 1, "assistant", ""), (None, 0, "assistant", "x" * 5000), (101, None, "user", "no turn"), (102, 3, "assistant", LONG), (103, 0, "user", "twice"), (103, 0, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).repartition(parts)
    found = chat.read_back(chat.format_events(chat.events_of_turns(turns), part_chars=3000)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == brute_chat(rows) and len(found) == len({r[0] for r in rows})
    kinds = {r.kind for r in chat.events_of_turns(turns).select("kind").distinct().collect()}
    assert kinds == {"delta", "edit", "regenerate"}
    assert chat.read_back(chat.format_events(chat.events_of_turns(turns.limit(0)))).count() == 0


def test_chat_ties_do_not_depend_on_the_layout(spark):
    rows = [(1, 0, "user", f"tie {i}") for i in range(30)]
    found = [chat.read_back(chat.format_events(chat.events_of_turns(spark.createDataFrame(x, "conv_id long, turn long, role string, text string").repartition(n)))).collect() for x, n in ((rows, 1), (rows[::-1], 5))]
    assert found[0] == found[1]


def test_chat_folds_events(spark):
    events = [(1, 0, 1, 0, "delta", "user", "Hel"), (1, 0, 1, 1, "delta", "user", "lo"), (1, 1, 2, 0, "delta", "assistant", "first"), (1, 2, 3, 0, "delta", "user", "gone"), (1, 3, 2, 0, "regenerate", None, None), (1, 4, 2, 0, "delta", None, "sec</s>ond"), (1, 5, 1, 0, "edit", None, "Hi"), (1, 6, 9, 0, None, None, "x"), (2, 0, 1, 0, "delta", None, None)]
    table = spark.createDataFrame(events, "conv_id long, seq long, message_id long, step long, kind string, role string, text string")
    found = {r.conv_id: r for r in chat.format_events(table).collect()}
    assert [(r, t) for r, t, _, _ in chat.parse(found[1].formatted)] == [("user", "Hi"), ("assistant", "sec</s>ond")]
    assert "</s>" not in found[1].formatted and [(r, t) for r, t, _, _ in chat.parse(found[2].formatted)] == [("", "")]
    assert chat.format_events(table.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\\\|im_end|>", "\\", "<<SYS>><</SYS>>", "<<s>", "a\n<|im_start|>b", *chat.CONTROL])
def test_chat_escapes_reversibly(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_sentencepiece_offsets(spark, docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_offsets.encode_with_offsets(docs, path).collect()
    assert len(rows) == len(awkward()) and {r.extra for r in rows} == {r[2] for r in awkward()}
    for r in rows:
        text = r.text or ""
        ids = tool.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == tool.decode(ids) and r.n_tokens == len(ids)
        bounds = np.frombuffer(r.bounds, "<i4")
        assert len(bounds) == len(ids) + 1 and bounds[0] == 0 and bounds[-1] == len(text.encode()) and (np.diff(bounds) >= 0).all()
        pieces = tool.encode(text, return_type="proto").pieces
        at = [p.begin for p in pieces if not re.fullmatch(r"<0x..>", p.piece)]
        mine = [int(b) for b, p in zip(bounds[1:], pieces) if not re.fullmatch(r"<0x..>", p.piece)]
        assert mine == at
    assert sentencepiece_offsets.encode_with_offsets(empty, path).count() == 0


def test_character_map_takes_the_longest_prefix():
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec
    mine = sentencepiece_offsets.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in ["ﬁne  １２ ｶﾞ", "é vs é", "  a\tb ", "", "㍿ ½", "plain"]:
        normal, source = mine(text)
        assert normal.decode() == rule.normalize(text) and len(source) == len(normal) + 1


def test_normaliser_over_whole_documents(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = pb.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec
    mine = sentencepiece_offsets.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        normal, source = mine(r.text or "")
        assert normal.decode() == rule.normalize(r.text or "") and len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()


def test_sentencepiece_with_a_map_and_symbols(spark, tmp_path, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    rule = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    for i, symbol in enumerate(["①x", "<｜x｜>"]):
        proto.pieces[-1 - i].piece, proto.pieces[-1 - i].type = symbol, pb.ModelProto.SentencePiece.USER_DEFINED
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t, 0) for i, t in enumerate(["ﬁne ①x① １２ ﬂow", "a <｜x｜>é ｘ", "㍿ ½ e\u0301", "", None, "  \t "])]
    rows += [(100 + i, r.text, 0) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    table = spark.createDataFrame(rows, DOCS).withColumn("bounds", F.lit("clash"))
    for r in sentencepiece_offsets.encode_with_offsets(table, path).collect():
        ids = tool.encode(r.text or "", add_bos=True, add_eos=True)
        bounds = np.frombuffer(r.bounds, "<i4")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and len(bounds) == len(ids) + 1 and (np.diff(bounds) >= 0).all()
        pieces = tool.encode(r.text or "", return_type="proto").pieces
        spelled = [k for k, p in enumerate(pieces) if not re.fullmatch(r"<0x..>", p.piece)]
        assert [int(bounds[k + 1]) for k in spelled] == [pieces[k].begin for k in spelled]


def test_wu_manber(spark, docs, empty):
    items = [("b", " ".join(PASSAGE.split()[5:25])), ("a", "SIX! one"), ("c", "x"), ("d", None), ("e", "!!"), (None, "same text here"), ("b", "same TEXT")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for item, text in items:
        w = split(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if w else []:
            windows.setdefault(tuple(w[k : k + m]), set()).update({item} - {None})
    for size in (10**9, 60):  # one pass, several passes
        for r in decontaminate.find_contamination(docs, benchmark, pass_bytes=size).collect():
            w, hit, names = split(r.text), set(), set()
            for m in {len(x) for x in windows}:
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in windows:
                        hit |= set(range(k, k + m))
                        names |= windows[tuple(w[k : k + m])]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == (len(w), len(hit), sorted(names))
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    assert decontaminate.remove_contaminated(docs, benchmark.limit(0)).count() == len(awkward())


def test_wu_manber_pieces_and_columns(spark):
    item = " ".join(f"q{i}" for i in range(12))
    text = " ".join(["a" * 400_000, "b", *item.split(), "c" * 700_000, *item.split()[:9], "d", *item.split()])
    n, spans, items = decontaminate._search(text, decontaminate.Patterns([("x", item), (None, "c c"), ("y", "b q0")], 10), 9)
    assert (n, spans, items) == (37, [(1, 14), (25, 37)], {"x", "y"}) and len(text) > decontaminate.PIECE
    rows = spark.createDataFrame([(1, "k", item, 5, "s")], "doc_id long, items string, text string, n_words int, spans string")
    found = decontaminate.find_contamination(rows, spark.createDataFrame([(None, item)], "item_id string, text string")).first()
    assert (found.doc_id, found.n_words, len(found.spans), found["items"]) == (1, 12, 1, [])


def test_license_scan(spark, empty):
    mit = dict(license_scan.TEXTS)["MIT"]
    rows = [(1, "Copyright (c) 2020 A. Person\n" + mit.upper().replace(",", " ;"), 0), (2, "text\nLicensed under the Apache Licence, version 2.0!\nmore", 0), (3, None, 0), (4, "", 0), (5, "released under the MIT license", 0), (5, "© me", 0), (None, "x", 0)]
    found = {(r.doc_id, r.text_digest is None): r for r in license_scan.scan_licenses(spark.createDataFrame(rows[:5] + rows[6:], DOCS)).collect()}
    assert found[1, False].license == "MIT" and (found[2, False].license, found[2, False].notices, found[2, False].n_notices) == (None, "Apache-2.0", 1)
    assert found[3, True].license is None and found[4, False].license is None and found[5, False].license == "MIT" and found[None, False].n_notices == 0
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_whole_texts(spark):
    wrapped = lambda text, width: "\n\n".join(textwrap.fill(" ".join(part.split()), width) for part in text.split("\n\n"))
    want = []
    for name, text in [*license_scan.TEXTS, *license_scan.MORE_TEXTS]:
        want += [(name, head + wrapped(text, width)) for width in (28, 60, 72, 99, 120, 10_000) for head in ("", "Copyright A. Person\n\n", f"{license_scan.TITLES[name][0]}\n\n© 2020 A. Person. All rights reserved.\n\n")]
        want += [(name, "\n".join(wrapped(text, 10_000).split("\n")).replace(" ", "\n"))]
    for path in license_scan.LONG.glob("*.txt"):
        want += [(path.stem, path.read_text()), (path.stem, path.read_text().replace("\n", "\r\n").upper())]
    mit = dict(license_scan.TEXTS)["MIT"]
    want += [(None, mit.replace("COPYRIGHT HOLDERS BE LIABLE", "HOLDERS BE LIABLE")), (None, mit + "\nmore"), (None, "Copyright 2020 A. Person")]
    found = {r.doc_id: r.license for r in license_scan.scan_licenses(spark.createDataFrame([(i, text, 0) for i, (_, text) in enumerate(want)], DOCS)).collect()}
    assert [found[i] for i in range(len(want))] == [name for name, _ in want]
    assert {name for name, _ in want} >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}


def test_paragraph_dedup_recall_follows_the_ratio(spark):
    rows = []
    for i in range(100):
        line = [f"w{i}x{k}" for k in range(60)]
        near = [w + "y" if k in (20, 40) else w for k, w in enumerate(line)]  # 46 of 66 shingles alike
        rows += [(2 * i, " ".join(line), 0), (2 * i + 1, " ".join(near), 0)]
    left = {r.doc_id: r.n_words_left for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(rows, DOCS), ratio=Fraction(3, 5)).collect()}
    assert all(left[i] == (0 if i % 2 else 60) for i in range(200))
    assert paragraph_dedup.tune(0.8, paragraph_dedup.RECALL) == 10


def test_paragraph_dedup(spark, docs, empty):
    rows = {(r.doc_id, r.text and r.text[:12]): r for r in paragraph_dedup.dedup_paragraphs(docs).collect()}
    found = {r.doc_id: r for r in rows.values()}
    assert found[41].n_words_cut >= 60 and found[41].keepers == [40] and found[40].n_words_cut == 0 and found[42].n_words_cut == 0
    assert found[41].text.startswith("own41x0 ") and found[41].text.endswith("own5x49 end") and found[41].n_words_left < 125
    assert found[21].n_words_cut > 0 and found[20].n_words_cut == 0 and found[2].text is None and found[6].text == LONG
    assert paragraph_dedup.dedup_paragraphs(empty).count() == 0
    assert paragraph_dedup.tune(0.8, 0.97) == 5


def test_paragraph_dedup_cuts_many_texts_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else "  Two\n\nwords \t" if i % 50 == 9 else " ".join(f"{'É' if x % 7 else 'A'}{x}" for x in rng.integers(0, 999, 1 + 3 * i % 190)) + "\n " * (i % 3) for i in range(300)]
    pieces, lines, want = [], [], []
    for i, t in enumerate(texts):
        data, spans, keepers = (t or "").encode(), [], set()
        begins, _, hashes = W.word_hashes(data.translate(W.LOWER_WORDS))
        bounds = [*paragraph_dedup.cuts(hashes, np.array([len(hashes)])).tolist(), len(hashes)] if len(hashes) else [0]
        k = len(bounds) - 1
        # the first two and the last two pieces of every text, so that runs of texts that follow each other touch
        chosen = sorted({*range(min(2, k)), *range(max(0, k - 2), k)})
        pieces.append([{"n": p, "lo": -p - i} for p in chosen][::-1] or None)
        runs = [chosen] if k <= 4 else [chosen[:2], chosen[2:]]
        for r in filter(None, runs):
            if bounds[r[-1] + 1] - bounds[r[0]] >= 12:
                spans.append((int(begins[bounds[r[0]]]), int(begins[bounds[r[-1] + 1]]) if bounds[r[-1] + 1] < len(begins) else len(data)))
                keepers |= {-p - i for p in r}
        whole = len(hashes) >= 20 and i % 5 == 0
        lines.append([{"n": 0, "lo": paragraph_dedup.NO_ID}] if whole else None)
        if whole:
            spans.append((0, data.find(b"\n") + 1 or len(data)))
            keepers.add(None)
        spans.sort()
        for j in range(len(spans) - 1, 0, -1):
            if spans[j][0] <= spans[j - 1][1]:
                spans[j - 1 : j + 1] = [(spans[j - 1][0], max(spans[j - 1][1], spans[j][1]))]
        gone = sum(len(data[a:b].split()) for a, b in spans)
        want.append((spans, sorted(keepers - {None}), None in keepers, gone, len(data.split()) - gone))
    listed = pa.list_(pa.struct([("n", pa.int32()), ("lo", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.string()), pa.array(pieces, listed), pa.array(lines, listed)], ["doc_id", "text", "_pieces", "_lines"])
    calls, hashed = [], W.word_hashes
    monkeypatch.setattr(W, "word_hashes", lambda text: calls.append(len(text)) or hashed(text))
    for some in (batch, batch.slice(13, 200)):
        calls.clear()
        (out,) = paragraph_dedup._apply(2, 12, 20)(iter([some]))
        assert len(calls) <= 2  # not once for each text
        for r in out.to_pylist():
            spans, keepers, null, gone, left = want[r["doc_id"]]
            assert [(x["start"], x["end"]) for x in r["cut"]] == spans and (r["n_words_cut"], r["n_words_left"]) == (gone, left)
            assert [k for k in r["keepers"] if k is not None] == keepers and (None in r["keepers"]) == null
            assert r["text"] is None if texts[r["doc_id"]] is None else len(r["text"].split()) == left


def brute_repeats(rows):
    """For each document, which of its words stand in a run of at least 50 that a document with a smaller id has as well."""
    words = {i: (t or "").lower().split() for i, t in rows}
    seen, out = {}, {}
    for i in sorted(words):
        w, hit = words[i], set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                hit |= set(range(k, k + 50))
        out[i] = hit
    return words, out


def test_paragraph_dedup_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"{a}{b}" for a in ("ba", "de", "mi", "so", "tu", "ra") for b in ("l", "n", "rt", "st", "x", "mp", "gh")]
    some = lambda n: [str(x) for x in rng.choice(pool, n)]
    passages = [some(int(n)) for n in rng.integers(55, 90, 6)]
    rows = []
    for i in range(60):
        parts = [some(int(rng.integers(5, 60))) for _ in range(4)]
        if i % 2:
            parts.insert(int(rng.integers(0, 5)), passages[i % 6])
        rows.append((i, " ".join(w for p in parts for w in p) if i % 3 else "\n".join(" ".join(p) for p in parts), 0))
    wrapped = textwrap.fill(" ".join(passages[0]), 60)  # lines of about ten words
    rows += [(100, f"alpha\n\n{wrapped}\n\nbeta", 0), (101, None, 0), (102, "", 0)]
    words, repeated = brute_repeats([r[:2] for r in rows])
    for parts in (1, 5):
        for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(rows, DOCS).withColumn("keepers", F.lit("clash")).repartition(parts)).collect():
            cut, at, left = set(), 0, (r.text or "").lower().split()
            text = next(t for i, t, _ in rows if i == r.doc_id) or ""
            for s in r.cut:
                before = len(text.encode()[: s.start].split())
                cut |= set(range(before, before + len(text.encode()[s.start : s.end].split())))
            assert left == [w for k, w in enumerate(words[r.doc_id]) if k not in cut] and r.n_words_cut == len(cut)
            assert len(repeated[r.doc_id] - cut) <= 0.35 * len(repeated[r.doc_id])  # a few words at a passage's ends may stay
            if not repeated[r.doc_id]:
                assert len(cut) <= 20
            assert all(k is None or k < r.doc_id for k in r.keepers)
    near = [(1, " ".join(passages[1]), 0), (2, " ".join([*passages[1][:30], "other", *passages[1][31:]]), 0), (None, "\n".join(" ".join(passages[1][k : k + 9]) for k in range(0, len(passages[1]), 9)), 0), (2, " ".join(passages[1]), 0)]
    left = sorted(((r.doc_id, r.n_words_left, r.keepers) for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(near, DOCS)).collect()), key=repr)
    assert [x[0] for x in left] == [1, 2, 2, None] and left[3][1] > 0 and all(x[1] < 20 for x in left[:3]) and left[0][2] == [None]


def brute_components(rows, n, ratio):
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().translate(W.LOWER_WORDS).split()
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and Fraction(both, len(sets[i] | sets[j])) >= ratio:
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "ratio"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates(spark, docs, empty, n, ratio, monkeypatch):
    from caravan.llm import similarity

    monkeypatch.setattr(similarity, "SHORT", 4)  # long lists go by blocks here, too
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            w[k] = f"e{i}_{k}"
        near.append((200 + i, " ".join(w), 0))
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    patterned = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]  # different words of one pattern
    rows = awkward() + near + [(300, " ".join(f"{w} x{i}" for i in range(6) for w in patterned), 0)]
    found = bottomk.near_duplicates(spark.createDataFrame(rows, DOCS), n, ratio).collect()
    sets, roots = brute_components(rows, n, ratio)
    smallest: dict = {}
    for r, x in zip(rows, roots):
        if r[0] is not None:
            smallest[x] = min(smallest.get(x, r[0]), r[0])
    want = sorted(((r[0], zlib.crc32((r[1] or "").encode()), len(s), smallest.get(x) if s else r[0]) for r, s, x in zip(rows, sets, roots)), key=repr)
    assert sorted(((r.doc_id, r.tag, r.n_shingles, r.component_id) for r in found), key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert bottomk.near_duplicates(empty, n, ratio).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    found = dict((r.id, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(51)} == {0} and {found[100 + i] for i in range(30)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_keep_columns_of_their_own_names(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), 7, "mine", 3)], "doc_id long, text string, n_words int, spans string, kept int")
    for out in (quality_rules.keep(rows, quality_rules.DecisionList([])), decontaminate.remove_contaminated(rows, spark.createDataFrame([], "item_id long, text string")), bottomk.deduplicate(rows)):
        assert out.columns == rows.columns and out.collect() == rows.collect()
