"""The pipeline operators against brute force, planted cases and awkward inputs."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import queries
from meshwork.llm.common import Memo, Scratch
from meshwork.llm.components import connected_components
from meshwork.llm.decontamination import contaminated
from meshwork.llm.fixity import audit
from meshwork.llm.license_scan import scan_licenses
from meshwork.llm.line_dedup import dedup_lines, line_components
from meshwork.llm.ngram_join import jaccard_components
from meshwork.llm.packing import WordEncoder, column_generation, pack, tail_bounds
from meshwork.llm.permutation_index import PivotFiles, choose_pivots, nearest_pivots, permutation_search
from meshwork.llm.pii import ADDED, BASE, base_spans, estimate_reliabilities, find_pii, luhn
from meshwork.llm.token_counts import PieceCounter, count_tokens
from meshwork.llm.toxicity import score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, class long, votes string"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, start=0):
    """documents with columns whose names clash with the operators' own."""
    rows = [(start + i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", " ", "one", prose(1, 40), prose(1, 40), prose(2, 6000), "a b c d e f"]


@pytest.fixture(scope="module")
def awkward(spark):
    own = docs_of(spark, AWKWARD)
    return own.unionByName(own.where("doc_id in (0, 4)"))


def test_token_counts_match_the_library(spark, awkward):
    texts = [*AWKWARD, " a", "a ", "a  b   c", "x\n\n y", "▁a ▁▁ b", "日本 語", "é " * 40]
    model = PieceCounter(PIECES)
    assert model.counts([t or "" for t in texts]) == [len(model.model.encode(t or "")) for t in texts]
    rows = count_tokens(awkward, PIECES).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(AWKWARD)), 0, 4])
    for r in rows:
        text = AWKWARD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := len(model.model.encode(text)), n > 4096)


def fuzzed(seed, n):
    """Strings over all scripts, of letters, marks, blanks and words whose lower case or composed form is another length."""
    rng = random.Random(seed)
    every = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    latin, marks = [chr(c) for c in range(0x20, 0x250)], list(".,;:!?|*$%&#()[]\"/ \n\t'’▁-_\u0301\u0327\u0307İIıſßŉ\u00a0\u3000\u2028\r\x85 <>")
    words = "The PEKİ, TABİ. BELKİ! (İ) it's DON'T we'LL 12 x3 <|endoftext|> <|startoftext|> </w> <s> Ως ΑΣ ﬁ ㎏ é ÉTÉ straße ▁a▁▁ ĳZ".split()
    pick = lambda r: chr(rng.choice(every)) if r < 0.3 else rng.choice(latin) if r < 0.6 else rng.choice(marks) if r < 0.9 else rng.choice(words)
    return ["".join(pick(rng.random()) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_ids_and_counts_equal_the_libraries_in_all_scripts():
    texts = fuzzed(11, 100_000)
    pieces, words = PieceCounter(PIECES), WordEncoder(WORDS)
    assert pieces.apart and words.parted
    assert pieces.counts(texts) == [len(x) for x in pieces.model.encode(texts, num_threads=1)]
    library = words.model.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(words.encode(t), words.kind).tolist() == x.ids for t, x in zip(texts, library, strict=True))


def test_memos_are_bounded():
    memo = Memo(lambda k: k * 2, most=10_000)
    assert all(memo[str(i)] == str(i) * 2 for i in range(1000)) and len(memo) < 100 and memo["x" * 65] == "x" * 130 and "x" * 65 not in memo


def test_scratch_tables_go_but_for_those_that_results_read(spark, tmp_path):
    with Scratch(spark) as scratch:
        gone, stays = scratch.written(spark.range(3), "gone"), scratch.written(spark.range(4), "stays", keep=True)
        name = scratch.bucketed(spark.range(5), "ids", "id", 2) and scratch.tables[0]
        assert gone.count() == 3
    assert stays.count() == 4 and not spark.catalog.tableExists(name)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.schema("id long").parquet(f"{scratch.root}/1_gone").count()


def test_token_counts_go_through_the_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    docs = docs_of(spark, ["a b", "a b", "c"])
    first = count_tokens(docs, PIECES, path).collect()
    assert spark.read.parquet(path).count() == 2
    assert sorted(count_tokens(docs, PIECES, path).collect()) == sorted(first)
    assert spark.read.parquet(path).count() == 2


def test_packing_is_an_exact_round_trip(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    pieces = pack(awkward, WORDS).toPandas()
    for i, text in enumerate(AWKWARD):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        copies = 2 if i in (0, 4) else 1
        own = pieces[pieces.doc_id == i]
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048
    assert pack(docs_of(spark, []), WORDS).count() == 0


def test_column_generation_finds_whole_fillings():
    units, counts = np.array([3, 5, 8]), np.array([10, 10, 10])
    patterns, whole = column_generation(units, counts, 16)
    assert (patterns @ units == 16).all() and (whole @ patterns <= counts).all() and whole.sum() >= 8
    assert tail_bounds(2048 + 5, 2048) == [2052, 2053]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components_by_force(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(5)
    base, passage = [prose(s, n) for s, n in ((10, 60), (11, 200), (12, 400))], prose(13, 80)
    texts = [*AWKWARD, *base, *(f"{passage} {prose(100 + i, 15)}" for i in range(90))]
    for b in base:
        texts += [edited(b, rng, rng.randrange(1, 5)) for _ in range(100)]
    words = base[1].split()  # copies that lack some of its words share the shingles across the gaps
    for _ in range(90):
        gone = set(rng.sample(range(200), rng.randrange(1, 9)))
        texts.append(" ".join(w for i, w in enumerate(words) if i not in gone))
    chain = base[2]
    for _ in range(12):
        chain = edited(chain, rng, 6)
        texts.append(chain)
    component, n = components_by_force(texts)
    for frequent in (64, 4):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs_of(spark, texts), frequent_from=frequent).collect()}
        assert got == {i: (n[i], component[i]) for i in range(len(texts))}
    assert jaccard_components(docs_of(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_line_dedup_keeps_one_line_of_each_component(spark):
    rng, long = random.Random(3), prose(20, 60)
    near = edited(long, rng, 1)
    texts = [f"first line here stays\n{long}\nx", f"{near}\nanother line of its own", long, None, "", "short\nshort", prose(21, 30)]
    kept = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert kept == {0: texts[0], 1: "another line of its own", 3: None, 4: "", 5: texts[5], 6: texts[6]}
    assert dedup_lines(docs_of(spark, texts)).columns == docs_of(spark, []).columns
    assert line_components(docs_of(spark, [])).count() == 0


def test_line_dedup_recall_against_brute_force(spark):
    rng = random.Random(9)
    base = [prose(300 + i, 40) for i in range(30)]
    lines = base + [edited(b, rng, rng.randrange(1, 4)) for b in base for _ in range(3)]
    cut = lambda s: {m for m in re.findall(r"(?<![0-9a-zß-ɏ])(?=([^ ].{0,15}))", s)}
    sets = [cut(x) for x in lines]
    want = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = line_components(docs_of(spark, lines)).collect()
    place = {r.doc_id: r.kept_doc_id for r in rows}
    assert sum(place.get(i, -1) == place.get(j, -2) for i, j in want) >= 0.97 * len(want)
    for r in rows:
        assert r.doc_id % 30 // 1 == r.doc_id % 30 and (r.doc_id - 30) // 3 == (r.kept_doc_id - 30) // 3 or r.doc_id < 30 or r.kept_doc_id < 30


def test_line_dedup_finds_edited_lines_of_ordinary_length(spark):
    rng = random.Random(13)
    base = [prose(1300 + i, 10 + i % 21) for i in range(200)]
    lines = [*base, *(edited(b, rng, 1) for b in base)]
    cut = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    want = [i for i, b in enumerate(base) if len((a := cut(b)) & (c := cut(lines[200 + i]))) >= 0.8 * len(a | c)]
    place = {r.doc_id: r.kept_doc_id for r in line_components(docs_of(spark, lines)).collect()}
    assert len(want) >= 100 and sum(place.get(i, -1) == place.get(200 + i, -2) for i in want) >= 0.97 * len(want)
    assert all(place[i] % 200 == i % 200 for i in place)
    # every character counts as one, whatever the script
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80))
    assert line_components(docs_of(spark, [cjk, cjk[:79] + "x", cjk[::-1]])).where("doc_id < 2 and kept_doc_id = 0").count() == 2


def test_line_dedup_reads_all_white_space_as_one_blank(spark):
    line = "six words of one short line"
    texts = [line, f"{line}\r", f"\t{line}", line.replace(" ", "  "), line.replace(" ", "\u00a0"), line.replace(" ", "\t \u3000"), "quite another line than that"]
    assert {(r.doc_id, r.kept_doc_id) for r in line_components(docs_of(spark, texts)).collect()} == {(i, 0) for i in range(6)}


def test_line_dedup_groups_equal_short_lines(spark):
    docs = docs_of(spark, ["short\n\nshorts", "Short ", "\n", "我们今天去北京看朋友", "x\n我们今天去北京看朋友"])
    places = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in line_components(docs).collect()}
    assert places == {(0, 0, 0, 0), (1, 0, 0, 0), (3, 0, 3, 0), (4, 1, 3, 0)}
    assert dedup_lines(docs).count() == 5 and dedup_lines(docs, exact_from=1).count() == 4


def test_line_dedup_links_near_pairs_that_share_boilerplate(spark):
    rng, shared, lines = random.Random(12), prose(40, 50).split(), []
    for i in range(300):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuv", k=7)) for _ in range(11)]
        lines += [" ".join(shared + own[:10]), " ".join(shared + own[:9] + own[10:])]
    place = {r.doc_id: r.kept_doc_id for r in line_components(docs_of(spark, lines)).collect()}
    assert sum(place.get(2 * i, -1) == place.get(2 * i + 1, -2) == 2 * i for i in range(300)) >= 297


def test_line_dedup_tells_families_apart_that_share_most_words(spark):
    rng, shared, lines = random.Random(21), prose(41, 33).split(), []
    for _ in range(300):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuv", k=6)) for _ in range(7)]
        for _ in range(3):
            lines.append(" ".join(shared + [w if rng.random() > 0.15 else "".join(rng.choices("abcdefghijklmnopqrstuv", k=6)) for w in own]))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    true = [(i, j) for f in range(0, 900, 3) for i in range(f, f + 3) for j in range(f, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows = line_components(docs_of(spark, [*lines, None, "", lines[5]])).collect()
    place = {r.doc_id: r.kept_doc_id for r in rows}
    assert len(true) > 300 and sum(place.get(i, -1) == place.get(j, -2) for i, j in true) >= 0.97 * len(true) and place[902] == place[5]


def test_line_dedup_of_very_long_and_repeated_rows(spark):
    long = prose(22, 8000)
    docs = docs_of(spark, [long, edited(long, random.Random(1), 40), prose(23, 8000).replace("w", "v"), "line of its own that nobody repeats"])
    rows = {(r.doc_id, r.kept_doc_id, r.kept) for r in line_components(docs.unionByName(docs)).collect()}
    assert rows == {(0, 0, True), (1, 0, False)}


def brute_pii(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("ab@@..1259+-() 0%_\né", k=rng.randrange(60)))
        assert [f"{BASE[k]}:{s}:{e}" for k, s, e in base_spans(text)] == brute_pii(text)
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert [BASE[k] for k, _, _ in base_spans("a@b.co, 10.0.0.1, 4111 1111 1111 1111, +1 (202) 555-0100")] == list(BASE)


def test_pii_adds_spans_and_keeps_base_ones(spark, awkward):
    secret = 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'
    texts = [f"say {secret} to me@here.org", "nothing here", f"{'x' * 50} plain", None, *[f"{secret} {i}" for i in range(20)], *[f"commit {hashlib.sha1(bytes([i])).hexdigest()}" for i in range(20)]]
    rows = {r.doc_id: r for r in find_pii(docs_of(spark, texts)).collect()}
    kinds = lambda r: [(BASE + ADDED)[s.kind] for s in r.spans]
    assert kinds(rows[0]) == ["email", "secret"] and rows[0].base[0].start == texts[0].index("me@")
    assert all(kinds(rows[i]) == [] for i in (1, 2, 3, *range(24, 44))) and all(kinds(rows[i]) == ["secret"] for i in range(4, 24))
    assert find_pii(awkward).count() == len(AWKWARD) + 2 and find_pii(docs_of(spark, [])).count() == 0


def test_reliabilities_follow_agreement():
    prior, yes, posterior = estimate_reliabilities({"111": 400, "000": 400, "110": 40, "001": 40, "--1": 10})
    assert 0.3 < prior < 0.7 and posterior["111"] > 0.95 > 0.05 > posterior["000"] and yes[0][0] > yes[1][0]


def test_toxicity_on_held_out_rows(spark):
    rng, texts = random.Random(2), []
    for i in range(600):
        words = prose(1000 + i, rng.randrange(5, 80)).split()
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["moron", f"zorgel{rng.choice('abc')}", "scum"])
        texts.append(" ".join(words))
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(None, 0, 1), (601, None, None)], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and [r.predicted for r in rows if r.doc_id >= 600] == [0, 0]
    assert score_toxicity(docs_of(spark, []), labels).count() == 0
    assert {r.doc_id: r.predicted for r in score_toxicity(docs_of(spark, ["you moron", "fine"]), labels.limit(0)).collect()} == {0: 1, 1: 0}


KINDS = ("other", "lost", "more", "letter")


def changed(words, share, rng, vocabulary, kinds=KINDS):
    """words with a share of them edited: replaced, lost, with one put after them, or with a letter changed."""
    out = []
    for w in words:
        kind = rng.choice(kinds) if rng.random() < share else "same"
        at = rng.randrange(len(w))
        out += {"same": [w], "other": [rng.choice(vocabulary)], "lost": [], "more": [w, rng.choice(vocabulary)], "letter": [w[:at] + "x" + w[at + 1 :]]}[kind]
    return out


def edits_by_force(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize(("share", "kinds"), [(0.15, KINDS), (0.25, KINDS), (0.25, ("letter",)), (0.4, ("letter",)), (0.5, ("letter",))])
def test_decontamination_recall_at_its_bound(spark, share, kinds):
    rng = random.Random(share)
    vocabulary = prose(30, 4000, 2500).split()
    items = [[rng.choice(vocabulary) for _ in range(16 + 4 * (i % 12))] for i in range(120)]
    held, texts = [], []
    for item in items:
        own = changed(item, share, rng, vocabulary, kinds)
        held.append(edits_by_force(" ".join(own), " ".join(item)) <= 0.25 * len(" ".join(item)))
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(40))] + own + [rng.choice(vocabulary) for _ in range(30)]))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = contaminated(docs_of(spark, [*texts, *(" ".join(rng.choices(vocabulary, k=300)) for _ in range(40))]), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert all(d == i for d, i in found)
    for lo, hi in ((0, 3), (3, 6), (6, 9), (9, 12)):  # by size of item
        own = [i for i in range(120) if held[i] and lo <= i % 12 < hi]
        assert len(own) >= 10 and sum((i, i) in found for i in own) >= 0.9 * len(own)
    for r in rows:  # the edits are those of the best stretch, by force
        words, item = texts[r.doc_id].split()[r.start_word :], " ".join(items[r.item_id])
        n = len(items[r.item_id])
        assert r.edits == min(edits_by_force(" ".join(words[: n + round(p * n)]), item) for p in (0, -1 / 16, 1 / 16, -1 / 8, 1 / 8))


def test_decontamination_finds_exact_and_edited_items(spark):
    rng = random.Random(4)
    items = [prose(500 + i, 15 + 2 * i, 10**6) for i in range(20)]
    texts = [f"{prose(700 + i, rng.randrange(30))} {t.upper() if i % 2 else t} {prose(800 + i, 20)}" for i, t in enumerate(items)]
    texts += [f"{prose(900 + i, rng.randrange(30))} {edited(t, rng, 1)} tail" for i, t in enumerate(items)]
    clean = [prose(2000 + i, 200) for i in range(20)]
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (None, items[0]), (52, "!"), (53, "")], "item_id long, text string").withColumn("found", F.lit("clash"))
    found = {(r.doc_id, r.item_id) for r in contaminated(docs_of(spark, [*texts, *clean, None, ""]), benchmark).collect()}
    assert {(i, i) for i in range(20)} <= found and len(found & {(20 + i, i) for i in range(20)}) == 20
    assert all(d % 20 == i and d < 40 for d, i in found)
    assert contaminated(docs_of(spark, texts), benchmark, block_bytes=60_000).count() == 40
    assert contaminated(docs_of(spark, texts), benchmark.limit(0)).count() == 0 == contaminated(docs_of(spark, []), benchmark).count()


def test_decontamination_of_short_long_and_unspaced_items(spark):
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(24))
    item = prose(31, 30, 10**6)
    benchmark = spark.createDataFrame([(1, "zyx wvu tsr"), (2, han), (3, item), (4, item)], "item_id long, text string")
    texts = ["a zyx, wvu. TSR b", "zyx wvu", "前" + han[:23] + "后", f"{prose(32, 9000)} {item} {prose(33, 9000)} {item}", prose(34, 500)]
    docs = docs_of(spark, texts)
    rows = contaminated(docs.unionByName(docs), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.edits) for r in rows) == [(0, 1, 1, 0), (2, 2, 1, 1), (3, 3, 9000, 0), (3, 4, 9000, 0)]


def test_license_scan(spark, awkward):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "GNU General Public\nLicense, and a general public license", "mit", None, "license mit license"]
    rows = {r.doc_id: r for r in scan_licenses(docs_of(spark, texts)).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels, rows[i].labels) for i in range(6)] == [
        (1, 3, 3, "mit", "mit"), (0, None, None, "", "cc-by-nc"), (2, 1, 6, "gpl", "gpl"), (0, None, None, "", ""), (0, None, None, "", ""), (1, 1, 1, "mit", "mit"),
    ]
    assert scan_licenses(awkward).count() == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in rows.values())


def test_merkle_audit(spark):
    rows = [(i, f"u{i}", f"page {i}" * 20) for i in range(300)] + [(7, "u7", "again"), (None, "x", "y"), (300, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    assert audit(pages, pages).count() == 0 and audit(pages.limit(0), pages.limit(0)).count() == 0
    other = pages.where("page_id <> 5 or page_id is null").withColumn("html", F.when(F.col("page_id") == 77, "bad").otherwise(F.col("html")))
    other = other.unionByName(pages.where("page_id = 9").withColumn("page_id", F.lit(900).cast("long")))
    assert {(r.id, r.status) for r in audit(pages, other, fanout=4).collect()} == {(5, "missing"), (77, "altered"), (900, "extra")}
    assert audit(pages, pages.limit(0)).count() == 301


def test_permutation_search_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[700:720] = x[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 64, 1), (5040, [float("nan")] + [1.0] * 63, 1), (5060, [None] + [1.0] * 63, 1), (5080, [1.0] * 3, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = permutation_search(vectors.where("vec_id % 20 = 0"), vectors.unionByName(vectors.where("vec_id = 40")), k=20).toPandas()
    hits = 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = sorted(range(3000), key=lambda j: (-s[j], j))[:20]
        own = got[got.query_id == i].sort_values("rank")
        assert np.allclose(own.score, s[own.vec_id]) and list(own["rank"]) == list(range(1, 21)) and own.vec_id.is_unique
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 3000 and set(got.query_id) == set(range(0, 3000, 20))
    assert permutation_search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pivots_are_not_one_sided_and_only_met_rows_are_scored(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    pivots = choose_pivots(vectors, 300)
    assert len(pivots) == 300 and abs(pivots[:, 0].mean()) < 0.3
    files = PivotFiles(x, pivots, 6)
    rows, saved = files.met(nearest_pivots(x[:1], pivots, 8)[0])
    assert len(rows) < 0.4 * len(x) and (saved > 0).all()
    far = {int(p): r for r, p in enumerate(nearest_pivots(x[:1], pivots, 8)[0])}
    for row, s in zip(rows[:50], saved[:50], strict=True):
        assert s == sum(2 * (8 - max(r, far[int(p)])) for r, p in enumerate(nearest_pivots(x[row : row + 1], pivots, 6)[0]) if int(p) in far)


def test_the_pipeline_keeps_clean_documents(spark, tmp_path):
    item = prose(1, 30, 10**6)
    clean = [prose(100 + i, 60, 10**6) for i in range(40)]
    texts = [*clean, *[f"{prose(300 + i, 30, 10**6)} moron {prose(400 + i, 10, 10**6)}" for i in range(20)], clean[0], clean[1] + " more", f"{prose(9, 20, 10**6)} {item}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(40 <= i < 60)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(range(40))


def test_every_number_has_its_query():
    numbers = Counter(re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n != "pipeline")
    assert numbers == Counter(map(str, range(1, 11))) and "pipeline" in queries.QUERIES
