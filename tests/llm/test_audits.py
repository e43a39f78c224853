"""Fingerprints, filter audits and conversation repair against brute force and on awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import conversations as conv
from meshwork.llm.filter_audit import RemovalPolynomial, audit_filters
from meshwork.llm.fingerprint import NOTHING, Print, edited_fingerprints, fingerprints, likeness, paragraphs, print_of, updated
from meshwork.llm.license_scan import scan_licenses
from meshwork.llm.pii import ADDED, BASE, find_pii
from meshwork.llm.toxicity import score_toxicity

DOCS = "doc_id long, text string, lang string, source string, range int, is_next boolean, part string, mask int, n long"


def docs_of(spark, rows):
    """(doc_id, text, source) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 7, True, "x", 3, 9) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    words = [f"word{rng.randrange(4000)}" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)


AWKWARD = ["", None, "\n", "a", "a\nb", "b\na", " ", "ä\U0001f600ö" * 5, prose(1, 30), prose(2, 400), "x y z\n" * 3000, prose(3, 60_000), "一二三四五六七八九十" * 30]


# personal data and toxicity


def test_long_secrets_and_masked_addresses_are_candidates(spark):
    rng = random.Random(6)
    token = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(n))
    tokens = [token(n) for n in (20, 200, 201, 400, 2000, 50_000)] + [token(40) for _ in range(20)]
    masked = [f"{'q' * 41} [at] example [dot] com", f"{'r' * 300}(at){'host' * 30}.com", "someone [at] here [dot] org"]
    texts = [f"api_key = {t} end" for t in tokens] + [f"mail {m} now" for m in masked] + ["a" * 300_000 + " [at] b", "ab" * 100_000, "x[at]" * 20_000, "a-" * 100_000 + "1"]
    rows = {r.doc_id: [((BASE + ADDED)[s.kind], s.start, s.stop) for s in r.spans] for r in find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(tokens):
        assert rows[i] == [("secret", 10, 10 + len(t))]
    for i, m in enumerate(masked, len(tokens)):
        assert rows[i] == [("email_masked", 5, 5 + len(m))]
    assert rows[len(tokens) + 3] == []


@pytest.mark.parametrize("times", [1, 100])
def test_a_rare_toxic_word_votes_on_tables_of_any_size(spark, times):
    rng = random.Random(7)
    clean = [f"plain{i}" for i in range(400)]
    sentence = lambda *more: " ".join([*rng.choices(clean, k=12), *more])
    common = ["zorgul", "fnarble", "mukwit", "drivok", "slunch", "grobnik", "pestrul", "vexnor"]
    texts = [(sentence(*[rng.choice(common)] * (i % 2)), 1) for i in range(40 * times)] + [(sentence(), 0) for _ in range(200 * times)] + [(sentence("quibblefrax"), 1) for _ in range(24)]
    rng.shuffle(texts)
    docs = docs_of(spark, [(i, t, "s") for i, (t, _) in enumerate(texts)]).repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    rare = [i for i, (t, _) in enumerate(texts) if "quibblefrax" in t]
    assert all(scored[i] == 1 for i in rare)
    assert sum(scored[i] for i, (_, y) in enumerate(texts) if not y) <= 0.01 * 200 * times


def test_scores_of_long_texts_and_repeated_rows(spark):
    texts = ["plain words here", "you idiot moron", prose(3, 60_000) + " idiot moron scum loser", None, ""] * 2
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(1, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs.unionByName(docs.where("doc_id in (1, 3)")), labels).collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.score)
    assert len(rows) == 12 and all(len(v) == 1 for v in by_id.values())
    assert by_id[0] == by_id[3] == by_id[4] and max(by_id[2]) > max(by_id[0]) and by_id[1] == by_id[6]


# fingerprints


def test_a_fingerprint_is_a_sum_over_paragraphs():
    a, b = print_of(["one two three four", "five", ""]), print_of(["", "five", "one two three four"])
    assert a.to_bytes() == b.to_bytes() and len(a.to_bytes()) == 768
    assert (a - print_of(["five"])).to_bytes() == print_of(["one two three four", ""]).to_bytes()
    assert (a + print_of(["six seven"])).to_bytes() == print_of(["one two three four", "", "six seven", "five"]).to_bytes()
    assert Print.from_bytes(a.to_bytes()).text() == a.text()
    assert print_of(paragraphs("")).to_bytes() == NOTHING.to_bytes() != print_of(paragraphs("\n")).to_bytes()
    different = ["a", "a\na", "a\n", "A", "a a", " a", "ab", "a\nb", "", "\n", "\n\n"]
    assert len({print_of(paragraphs(t)).to_bytes() for t in different}) == len(different)


def test_likeness_estimates_what_is_shared():
    for seed, share in itertools.product(range(6), (0.0, 0.25, 0.5, 0.75, 0.95)):
        own, other = ([f"{k}{seed} {k} w{i} x{i * 7}" for i in range(400)] for k in "ab")
        mixed = own[: int(400 * share)] + other[int(400 * share) :]
        assert abs(likeness(print_of(own), print_of(mixed)) - share) < 0.25 * (1.05 - share) + 0.05
    assert likeness(NOTHING, NOTHING) == 1 and likeness(NOTHING, print_of(["a b c"])) == 0
    x = print_of(["a b c d"] * 70_000)  # wraps around
    assert likeness(x, print_of(["a b c d"] * 70_000)) == 1 and x.to_bytes() != print_of(["a b c d"] * 69_999).to_bytes()


def edited_by_force(rows):
    """{(doc_id, text): (edited text, next text)} of (doc_id, text) rows with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i, t] = t[: len(t) - half] + following[:half], following
    return out


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_edits_and_their_fingerprints(spark, tasks):
    rng = random.Random(5)
    ids = rng.sample(range(-50, 10_000), len(AWKWARD) + 60)
    rows = [*zip(ids, AWKWARD + [prose(100 + i, rng.randrange(1, 80)) for i in range(60)], strict=True), (None, "no id\nat all")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = edited_fingerprints(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, texts = edited_by_force(rows), {i: t or "" for i, t in rows}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        text = texts[r.doc_id]
        edited, following = want[r.doc_id, text]
        a, b, c = (print_of(paragraphs(t)) for t in (text, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.text(), b.text())
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c)) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edits_of_repeated_rows_and_small_tables(spark):
    one = edited_fingerprints(docs_of(spark, [(1, "abcd", "s")])).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    assert edited_fingerprints(docs_of(spark, [(1, "abcd", "s")]).where("doc_id > 1")).count() == 0
    rows = [(1, "aaaa bbbb", "s")] * 40 + [(1, "cccc", "s")] + [(2, "dd", "s")] * 3
    got = edited_fingerprints(docs_of(spark, rows).repartition(4)).collect()
    assert Counter(r.doc_id for r in got) == {1: 41, 2: 3} and len({r.fingerprint for r in got}) == 3
    assert sum(r.near_next == 1 for r in got) >= 40


def test_prints_are_updated_without_their_documents(spark):
    docs = docs_of(spark, [(1, "a b c d\ne f g h\ni", "s"), (2, "x", "s"), (3, None, "s"), (None, "q", "s")])
    start = fingerprints(docs)
    new = spark.createDataFrame([(1, "new one here"), (9, "fresh"), (3, ""), *[(2, "hot") for _ in range(500)]], "doc_id long, text string").repartition(7)
    gone = spark.createDataFrame([(1, "e f g h"), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.fingerprint) for r in updated(start, new, gone).collect()}
    want = {1: ["a b c d", "i", "new one here"], 2: ["hot"] * 500, 3: [""], 9: ["fresh"], None: ["q"]}
    assert got == {k: print_of(v).to_bytes() for k, v in want.items()}
    whole = updated(fingerprints(docs.withColumn("doc_id", F.lit(0)))).collect()
    assert [bytes(r.fingerprint) for r in whole] == [print_of(["a b c d", "e f g h", "i", "x", "q"]).to_bytes()]


# filters


def test_removal_polynomial_by_orders():
    rng = random.Random(3)
    masks = [rng.randrange(32) for _ in range(300)]
    poly = RemovalPolynomial([sum(m & t == t for m in masks) for t in range(32)])
    for s in range(32):
        assert poly.survivors(s) == sum(m & s == 0 for m in masks)
    for i in range(5):
        by_orders = 0
        for order in itertools.permutations(range(5)):
            first = order[: order.index(i)]
            by_orders += sum(m >> i & 1 and not any(m >> j & 1 for j in first) for m in masks)
        assert poly.shapley(i) == Fraction(by_orders, 120)
        assert poly.derivative(i)[0] == sum(m >> i & 1 for m in masks)
    assert RemovalPolynomial([0] * 32).shapley(2) == 0


def filters_by_force(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        parts[s or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, own in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed, before = [x for x in left if x[0][f]], len(left)
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(removed)
                failing = sum(x[0][f] for x in own)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                out[part, order, step] = [len(left), before - len(left), failing - len(removed), alone, sum(x[1] for x in removed), sum(x[2] for x in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_by_force(spark):
    rng = random.Random(9)
    long = [prose(i, 260) for i in range(6)] + ["word " * 300, prose(7, 300) + " #", prose(8, 250).upper(), "A\x0bB\x1cC\x85D E " * 100, prose(9, 60_000)]
    texts = [*AWKWARD[:9], *long, "5 % of it"]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(300)]
    rows += [(1000 + i, long[0], "hot") for i in range(200)] + [(5, long[1], "a"), (5, long[1], "a"), (None, long[0], "a"), (None, None, None), (-4, long[2], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99_999, 1, 1), *[(1000 + i, 1, 0) for i in range(50)]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("z"))
    got = audit_filters(docs_of(spark, rows).repartition(6), known).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == filters_by_force(rows, labels)
    assert len(got) == 600 * 4
    assert audit_filters(docs_of(spark, rows).where("doc_id > 100000"), known).count() == 0
    assert audit_filters(docs_of(spark, rows), known.where("doc_id > 100000")).agg(F.sum("good_lost")).first()[0] == 0


# conversations


def solved_by_force(signature):
    """All ways to keep, rerole or delete each row with up to two rows inserted before each and at the end."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    choices = [[("D", "", 3)] if c == "d" else [("D", "", 3), ("K", c.lower(), c.isupper()), ("R", "u", 2 + c.isupper()), ("R", "a", 2 + c.isupper())] for c in signature]
    for picked in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(signature) + 1):
            roles = "".join(g + p[1] for g, p in zip(filled, picked, strict=False)) + filled[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(g) + p[0] for g, p in zip(filled, picked, strict=False)) + "I" * len(filled[-1])
                now = sum(p[2] for p in picked) + 2 * sum(map(len, filled)), audit
                best = now if best is None else min(best, now)
    return best


def test_signatures_are_solved_as_by_force():
    for n in range(3):
        for signature in map("".join, itertools.product("suaxSUAXd", repeat=n)):
            assert conv.solve(signature) == solved_by_force(signature), signature
    rng = random.Random(4)
    for _ in range(25):
        signature = "".join(rng.choices("suaxSUAXd", k=3))
        assert conv.solve(signature) == solved_by_force(signature), signature
    long = "".join(rng.choices("suaxSUAXd", k=5000))
    cost, audit = conv.solve(long)
    assert len(audit) - audit.count("I") == 5000 and cost >= 3 * long.count("d")
    assert conv.solve("ua" * 100) == (0, "K" * 200)


def repaired_by_force(rows):
    """Everything by plain Python, on {conv_id: rows}."""
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        own = by_conv[c]
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(key.encode()) % 20
        if n == 0:
            continue
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        own += [(t, role, text)] * (2 if n == 3 else 1)
    out = {}
    for c, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        blank = duplicate = truncated = 0
        seen, signature = set(), ""
        for _, role, text in own:
            inner = re.sub(r"[\x20\x09-\x0D]", "", text)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not inner:
                blank, letter = blank + 1, "d"
            elif (role, text) in seen:
                duplicate, letter = duplicate + 1, "d"
            elif inner[-1] not in ".!?":
                truncated, letter = truncated + 1, letter.upper()
            seen.add((role, text))
            signature += letter
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = solved_by_force(signature) if len(signature) < 4 else conv.solve(signature)
        lines, i, last = [], 0, "a"
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "user" if last != "u" else "assistant"
            last = role[0]
            lines.append(f"{role}:{text}")
        roles = "".join(x[0] for x in lines)
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[c] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations_are_repaired_as_by_force(spark):
    rng = random.Random(8)
    texts = ["Fine.", "Well!", "Cut off", " ", "", "\x0b\n", "Yes?\n ", "Ends with nbsp. ", None, "ü" * 5, "。", "A. B", prose(5, 20_000)]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "agent", "sys"]
    rows = [(c, rng.choice([None, *range(-2, 9)]) if c % 3 == 0 else t, rng.choice(roles[: 3 if c % 2 else 9]), rng.choice(texts)) for c in range(250) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, r, x) for c in range(1000, 1200) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Hello.")])]  # one conversation many times
    rows += [(None, t, "user", "Hi.") for t in range(3)] + [(7777, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)] + [(4, 1, "user", "Fine."), (4, 1, "user", "Fine.")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"5555:{t}".encode()) % 20 == 0)
    rows.append((5555, dropped, "user", "Gone."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("x"), "head": F.lit(1), "digest": F.lit("y"), "stays": F.lit(0)})
    got = conv.repair_conversations(table.repartition(7)).collect()
    want = repaired_by_force(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    empty = hashlib.sha256(b"").hexdigest()
    assert want[5555] == (0, 0, 0, 0, 0, 0, "", empty)
    assert conv.repair_conversations(table.where("conv_id > 100000")).count() == 0


# the pipeline, licenses


def tables_of(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_with_awkward_rows(spark, tmp_path):
    item = " ".join(f"benchword{i}" for i in range(30))
    long = "\n".join(" ".join(f"u{k}x{i}" for i in range(12)) for k in range(3000))
    rows = [(1, "a fine text about nothing in particular at all\nwith a second line of its own", "s"), (2, None, "s"), (3, "", "s"), (4, long, "s"), (None, "no id here but words that stay as they are", "s"),
            (5, f"before it {item} and after", "s"), (6, "you idiot moron scum loser trash", "s"), (7, "repeated row that is packed as often as it comes in", "s"), (7, "repeated row that is packed as often as it comes in", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, token int")
    folder = tables_of(spark, tmp_path / "a", docs, [(6, 1, 1), (1, 1, 0)], [(1, item)])
    got = corpus_pipeline.run(spark, folder).collect()
    kept = Counter(r.doc_id for r in got if r.start == 0)
    assert kept[1] == kept[2] == kept[3] == kept[4] == kept[None] == 1 and kept[5] == kept[6] == 0 and kept[7] >= 1
    pieces = defaultdict(int)
    for r in got:
        pieces[r.doc_id] += r.length
    assert pieces[2] == pieces[3] == 1 and pieces[4] > 2048
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    empty = tables_of(spark, tmp_path / "b", docs.limit(0), [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_license_base_by_force(spark):
    rng = random.Random(11)
    pool = ["MIT", "license", "License", "apache", "Apache", "general", "public", "mit", "x", "y.z", "lic\u0130ense", "g_p"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 40))) for _ in range(120)] + [None, "", "mit license " * 5000, "apache\nLICENSE\tgeneral-public-license"]
    labels = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for r in scan_licenses(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(str.maketrans(upper, upper.lower())))
        at = [(i, label) for i in range(len(words)) for phrase, label in labels.items() if tuple(words[i : i + len(phrase)]) == phrase]
        base = sorted({label for _, label in at})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(base) and set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
