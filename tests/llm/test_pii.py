import hashlib
import re

from signalbase.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in (re.finditer(p, text) if kind != "email" or "@" in text else ()) if valid(kind, m[0])]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{e}" for a, k, e in sorted(found))


HARD = [
    "a@b.com_x@y.z.q foo@bar@baz.com x@y @z.com .@-.-",
    "1.2.3.4.5.6.7.8 999.1.2.3.4 00255.1.1.1 256.1.1.1 1.2.3",
    "+1 (017) 555-7713 +1+22222222222 + 1 +12345678901234567 +1-.-.-2345678901",
    "4845 1681 1440 7329 4845168114407329 4845-1681-1440-7329 48451681144073290000000 4845  168114407329",
    "\U0001f600 x@y.com é 1.2.3.4",
    "",
    None,
    "1 " * 20_000,
    "a" * 100_000,
    "1" * 50_000,
    "1.2.3.4 " * 1500,
    "+1" * 10_000,
]


def test_base_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + k, t, "x") for k, t in enumerate(HARD)], "doc_id long, text string, base string")
    every = docs.unionByName(extra, allowMissingColumns=True)
    got = {r["doc_id"]: r for r in pii.digest_columns(pii.find_pii(every)).collect()}
    for r in every.collect():
        wanted, row = base(r["text"] or ""), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()
        assert set(wanted.split(",")) - {""} <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k, _ in PATTERNS] == [sum(x.startswith(f"{k}:") for x in wanted.split(",")) for k, _ in PATTERNS]


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(k, f"some prose here, please reach me at user{k}@host{k}.example.com any day of week {k}") for k in range(12)]
    hidden = [(100, "more prose there, please reach me at bob.b@intranet any day"), (101, "and we reach me at 4477 0900 123 any time")]
    clean = [(200 + k, f"the total came at {1234567 + k} units and item {7654321 + k} is sold") for k in range(12)]
    frame = spark.createDataFrame(seeds + hidden + clean, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest_columns(pii.find_pii(frame)).collect()}
    start = hidden[0][1].index("bob.b")
    assert got[100]["spans"] == f"email:{start}:{start + len('bob.b@intranet')}" and got[100]["n_email"] == 0 and got[100]["n_discovered"] == 1
    assert all(got[d]["n_discovered"] == 0 for d, _ in seeds + clean)


def test_repeated_and_empty(spark):
    rows = [(1, "write to a@b.com"), (1, "write to a@b.com"), (1, "other"), (None, "a@b.com")]
    got = pii.digest_columns(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


RUNS = ["-" * 10**6, "." * 10**6, "(" * 10**6, ")" * 10**6, "a" + "-" * 500_000 + "b 1", "1" + "-" * 500_000 + "2345 x", "@" * 300_000, "1.2.3." * 100_000, "a 1 " * 100_000]


def test_long_runs_take_linear_time(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(RUNS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest_columns(pii.find_pii(frame)).collect()}
    assert len(got) == len(RUNS) and got[0]["spans"] == ""


def test_contexts_are_words_of_any_length(spark):
    long = "w" * 500
    rows = [(1, f"{long} x{'y' * 300} 123456 {long}"), (2, "a@b.com c@d.com x1234"), (3, "(555-1234).")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["c"] for r in frame.select("doc_id", pii.candidates(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()}
    one = got[1][0]
    assert (one["left"]["left1"], one["left"]["left2"], one["right1"], one["instance"]) == ("x" + "y" * 300, long, long, "123456")
    assert [c["left"]["left1"] for c in got[2]] == [None, "a@b.com", "c@d.com"] and got[2][0]["right1"] == "c@d.com"
    assert [(c["start"], c["end"], c["instance"]) for c in got[3]] == [(0, 10, "(555-1234)")]


FRAMES = {"email": "please reach me at {} any day", "ip": "served by host {} since then", "card": "paid with card {} last week", "phone": "call me on {} after work"}
SEEN = {"email": "user{k}@host{k}.example.com", "ip": "10.0.{k}.7", "card": "4111 1111 1111 1111", "phone": "+1 555 010 {k:04d}"}
HIDDEN = {"email": "bob{k}@intranet", "ip": "10.0.{k}.777", "card": "4111-1111-{k:04d}", "phone": "0049 170 {k:07d}"}


def planted():
    rows, places = [], {}
    cards = [f"41111111{k:06d}{c}" for k in range(30) for c in range(10) if valid("card", f"41111111{k:06d}{c}")]
    for kind, frame in FRAMES.items():
        for k in range(30):
            seen = cards[k] if kind == "card" else SEEN[kind].format(k=k)
            rows.append((len(rows), f"prose {k} goes on, " + frame.format(seen)))
        for k in range(5):
            hidden = HIDDEN[kind].format(k=k)
            text = f"other prose {k}, and " + frame.format(hidden)
            places[len(rows)] = (kind, text.index(hidden), text.index(hidden) + len(hidden))
            rows.append((len(rows), text))
    rows += [(len(rows) + k, f"the total of lot {1234567 + k} was sold, and item {7654321 + k} too") for k in range(10)]
    return rows, places


def brute_bootstrap(rows):
    """Discovered (row, start, end, kind): the same graph in plain Python, over candidates by another pattern."""
    cands = []
    for d, text in rows:
        seeds = [(m.start(), m.end(), k) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(kind, m[0])]
        tokens = []
        pieces, i = list(re.finditer(r"\S+", text)), 0
        while i < len(pieces):
            start, last = pieces[i].start(), pieces[i]
            i += 1
            if "@" not in last[0] and not re.match("[^0-9]*[0-9]", last[0]):
                continue
            while last[0][-1] != "," and i < len(pieces) and text[last.end() : pieces[i].start()] == " " and pieces[i][0][0] in "(0123456789":
                last, i = pieces[i], i + 1
            run = text[start : last.end()].rstrip(",.")
            if "@" in run or sum(c.isdigit() for c in run) >= 4:
                tokens.append((start, start + len(run)))
        for i, (a, e) in enumerate(tokens):
            prev = tokens[i - 1][1] if i else 0
            nxt = tokens[i + 1][0] if i + 1 < len(tokens) else len(text)
            strip = lambda w: re.sub(r"^\W+|[^\w:=#]+$", "", w).lower()
            left, right = [strip(w) for w in text[prev:a].split()], [strip(w) for w in text[e:nxt].split()]
            pats = [f"L {left[-1]}"] * bool(left) + [f"LL {' '.join(left[-2:])}"] * (len(left) > 1) + [f"LR {left[-1]} _ {right[0]}"] * bool(left and right)
            rank = next((k for x, y, k in sorted(seeds, key=lambda s: (s[0], s[2])) if x < e and y > a), None)
            cands.append((d, a, e, text[a:e].lower(), pats, rank))
    graph = {}
    for *_, inst, pats, rank in cands:
        for p in pats:
            old = graph.setdefault(p, {}).get(inst)
            graph[p][inst] = rank if old is None else old if rank is None else max(old, rank)
    seeds = {}
    for members in graph.values():
        for inst, rank in members.items():
            if rank is not None:
                seeds[inst] = max(seeds.get(inst, -1), rank)
    known = {i: (r, 1.0) for i, r in seeds.items()}
    sure, named = None, -1
    while True:
        now = {}
        for p, members in graph.items():
            for kind in range(4):
                has = [known[i][1] for i in members if i in known and known[i][0] == kind]
                if len(has) >= pii.SUPPORT and sum(has) / (len(members) + 0.5) >= pii.CONFIDENCE:
                    now[p] = (sum(has) / (len(members) + 0.5), kind)
        gained = {}
        for p, (c, kind) in now.items():
            for i in graph[p]:
                if i not in seeds:
                    gained[i] = max(gained.get(i, (0.0, 0)), (c, kind))
        before, named = named, len(gained)
        if sure is None or named > before:
            sure = now
        if named <= max(before, 0):
            break
        known = {i: (r, 1.0) for i, r in seeds.items()} | {i: (kind, c) for i, (c, kind) in gained.items()}
    return {(d, a, e, max(sure[p] for p in pats if p in sure)[1]) for d, a, e, _, pats, rank in cands if rank is None and any(p in sure for p in pats)}


def test_planted_identifiers_by_kind(spark):
    rows, places = planted()
    # Columns named as the operator's own do not disturb it.
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, base string")
    got = pii.find_pii(frame).collect()
    added = {(r["doc_id"], s["start"], s["end"], s["rank"]) for r in got for s in r["added"]}
    names = [k for k, _ in PATTERNS]
    found = {kind: sum((d, a, e, names.index(kind)) in added for d, (k, a, e) in places.items() if k == kind) for kind in names}
    print("planted identifiers found of 5:", found)
    assert added == brute_bootstrap(rows)
    assert all(n >= 4 for n in found.values())
    assert not any(d >= len(rows) - 10 for d, *_ in added)


def test_very_many_identifiers_in_one_text(spark):
    """Linear in their number; a text of 20,000 took minutes when each candidate looked through all base spans."""
    text = " ".join(f"write to user{k}@mail{k % 7}.org or +49 30 {k:07d} now" for k in range(10_000))
    frame = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    row = pii.digest_columns(pii.find_pii(frame)).filter("doc_id = 1").first()
    assert row["n_email"] == 10_000 and row["n_phone"] == 10_000
    spans = {tuple(s.split(":")) for s in row["spans"].split(",")}
    assert {("email", str(m.start()), str(m.end())) for m in re.finditer(r"user\d+@mail\d\.org", text)} <= spans
