"""Shapes, line parsers, overlays, rotations, draws and the indexed store against plain versions."""

import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenbank.functions import lines as L
from lumenbank.functions import shapes
from lumenbank.operators import draws, overlay, rotation
from lumenbank.sources import store
from lumenbank.sources.snapshots import Snapshots

# Shapes


def plain_plan(text):
    """The study plan of a JSON text by plain Python, or None."""
    try:
        raw = json.loads(text, parse_constant=lambda c: None)
    except (ValueError, TypeError, RecursionError):
        return None
    is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    number = lambda x, test=lambda n: True: float(x) if is_number(x) and test(x) else None
    text_of = lambda x: x if isinstance(x, str) else None
    one_of = lambda x, values: x if isinstance(x, str) and x in values else None
    obj = lambda x: x if isinstance(x, dict) else None
    strings = lambda x: [s for s in x if isinstance(s, str)] if isinstance(x, list) else None

    def launch(x):
        if obj(x) is None or one_of(x.get("kind"), ["review", "drill", "quiz"]) is None:
            return None
        out = {"kind": x["kind"], "review": None, "drill": None, "quiz": None}
        if x["kind"] == "review":
            return out | {"review": {}}
        aim = {"cluster": text_of(x.get("cluster")) or None, "level": one_of(x.get("level"), shapes.LEVELS), "count": number(x.get("count"), lambda n: n > 0)}
        more = {"pi": text_of(x.get("pi")), "area": text_of(x.get("area"))} if x["kind"] == "drill" else {"mix": one_of(x.get("mix"), shapes.MIXES)}
        return None if None in (aim | more).values() else out | {x["kind"]: aim | more}

    def task(x):
        if obj(x) is None:
            return None
        got = {"id": text_of(x.get("id")), "type": one_of(x.get("type"), shapes.TASKS), "title": text_of(x.get("title")), "launch": launch(x.get("launch"))}
        if None in got.values() or not got["title"].strip(" "):
            return None
        t = obj(x.get("target"))
        target = {"cluster": text_of(t.get("cluster")), "level": one_of(t.get("level"), shapes.LEVELS), "pi": text_of(t.get("pi")), "area": text_of(t.get("area"))} if t is not None else None
        if target and None in (target["cluster"], target["level"]):
            target = None
        size = number(x.get("size"), lambda n: n > 0)
        return got | {"subtitle": text_of(x.get("subtitle")) or "", "size": size if size is not None else 1.0, "difficultyHint": one_of(x.get("difficultyHint"), shapes.HINTS) or "mixed", "target": target, "missIds": strings(x.get("missIds"))}

    def tasks(x):
        return [t for t in map(task, x) if t is not None] if isinstance(x, list) else None

    if obj(raw) is None or not text_of(raw.get("cluster")) or one_of(raw.get("level"), shapes.LEVELS) is None:
        return None
    t, today = obj(raw.get("today")), None
    if t is not None and text_of(t.get("date")):
        today = {"date": t["date"], "dismissed": strings(t.get("dismissed")), "custom": tasks(t.get("custom")), "recommended": tasks(t.get("recommended")) or None}
    created = number(raw.get("createdTs"))
    return {"cluster": raw["cluster"], "level": raw["level"], "eventDate": number(raw.get("eventDate")), "dailyGoal": number(raw.get("dailyGoal")), "createdTs": created if created is not None else 0.0, "diagnosticDone": raw.get("diagnosticDone") is True, "today": today}


def broken(draw, depth=0):
    """A JSON value of any kind, by chance one that fits."""
    scalars = [None, True, False, 0, -3, 2.5, 7, "", " ", "x", "ICDC", "drill", "quiz", "review", "hard", "balanced", 1e300, [], {}]
    if depth > 3 or draw.random() < 0.3:
        return draw.choice(scalars)
    aim = {"cluster": "c", "level": "ICDC", "count": 3, "pi": "p", "area": "a", "mix": "hard", "kind": draw.choice(["drill", "quiz", "review", "other"])}
    task = {"id": "t", "type": "quiz", "title": "T", "subtitle": "s", "size": 2, "difficultyHint": "easy", "launch": aim, "target": {"cluster": "c", "level": "ICDC", "pi": "p"}, "missIds": ["a", 1, "b"]}
    plan = {"cluster": "c", "level": "ICDC", "eventDate": 5, "dailyGoal": 4, "createdTs": 9, "diagnosticDone": True, "today": {"date": "d", "dismissed": ["x", 2], "custom": [task, 1], "recommended": [task]}}

    def spoil(x):
        if draw.random() < 0.09:
            return broken(draw, depth + 1)
        if isinstance(x, dict):
            return {k: spoil(v) for k, v in x.items() if draw.random() > 0.04}
        return [spoil(v) for v in x] if isinstance(x, list) else x

    return spoil(json.loads(json.dumps(plan)))


def test_plans_of_any_json(spark):
    """Texts cut short, values of the wrong kind at any depth, unknown words, huge numbers, nulls: never an error, always the plain result."""
    draw = random.Random(7)
    texts = [json.dumps(broken(draw)) for _ in range(500)]
    texts += [t[: draw.randrange(len(t) + 1)] for t in texts[:120]] + [None, "", "null", "[]", '{"cluster": "c", "level": "ICDC", "createdTs": 1e999}', "{" * 400, '"plain"', "\x00", '{"cluster":"c","level":"ICDC","eventDate":12345678901234567890123}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.plan for r in rows.select("id", shapes.coerce(F.col("text"), shapes.study_plan()).alias("plan")).collect()}
    kept = 0
    for i, t in enumerate(texts):
        want = plain_plan(t)
        held = got[i].asDict(recursive=True) if got[i] is not None else None
        assert held == want, t
        kept += bool(want and want["today"] and want["today"]["custom"])
    assert kept > 30


# Lines


def parsed(spark, text, make):
    return spark.createDataFrame([(text,)], "text string").select(make(L.lines(F.col("text"))).alias("x")).first().x


def plain_findings(text):
    out, now = [], None
    for line in text.split("\n"):
        m = re.match(r"\s*(FAIL|soft|note)\s+(\S+)\s+\[", line)
        if m:
            now = None if m[1] == "note" else (m[2], m[1], [])
            if now:
                out.append(now)
        elif now and line.startswith(" " * 10) and line.strip():
            now[2].append(line.strip())
        elif not line.strip():
            now = None
    return out


def plain_items(text):
    out = []
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            continue
        if re.match(L.BULLET, line):
            out.append(re.sub(L.BULLET, "", line).strip())
        elif out:
            out[-1] = f"{out[-1]} {line}".strip()
        else:
            out.append(line)
    return [x for x in out if x]


def test_report_findings(spark):
    draw = random.Random(3)
    kinds = ["FAIL q1 [stem]", "  soft q2 [len]", "note q3 [x]", " " * 12 + "why it fails", " " * 10 + "more", "      short indent", "", "  ", "FAIL", "text", "soft  q4  [a] b", " " * 11 + "FAIL q9 [nested]"]
    texts = ["\n".join(draw.choices(kinds, k=draw.randint(0, 30))) for _ in range(150)] + ["", "\n\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", L.findings(L.lines(F.col("text"))).alias("f"))
    for r in frame.collect():
        assert [(f.id, f.kind, f.lines) for f in r.f] == plain_findings(texts[r.id]), texts[r.id]


def test_list_items(spark):
    draw = random.Random(4)
    kinds = ["- one", "* two", "  • three", "1. four", "2) five", "goes on", "   and on", "", "-no space", "–  dash", "-", "10.5 is a number"]
    texts = ["\n".join(draw.choices(kinds, k=draw.randint(0, 20))) for _ in range(150)] + ["", "plain", "- "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", L.list_items(L.lines(F.col("text"))).alias("x"))
    for r in frame.collect():
        assert r.x == plain_items(texts[r.id]), texts[r.id]


DOCUMENT = """Intro line
EVENT SITUATION
You are the manager.
Exhibit A: Sales
| Month | Units |
| May | 12 |

TASKS:
- first task
  goes on
- second
Exhibit B
x | y
JUDGE QUESTIONS
Q1: Why this way?
and no other?
A: Because
of costs.
Question 2: And then?
Q: last one
A: yes
Self report:
Options: 4

Cost ok: yes
end of it
After: no"""


def test_a_whole_document(spark):
    headers = ["event situation", "tasks", "judge questions", "self report"]
    assert parsed(spark, DOCUMENT, lambda x: L.list_items(L.section(x, "tasks", headers))) == ["first task goes on", "second Exhibit B x | y"]
    assert parsed(spark, DOCUMENT, lambda x: L.section(x, "no such", headers)) == []
    assert [tuple(q) for q in parsed(spark, DOCUMENT, lambda x: L.questions(L.section(x, "judge questions", headers)))] == [("Why this way? and no other?", "Because of costs."), ("And then?", None), ("last one", "yes")]
    assert [tuple(p) for p in parsed(spark, DOCUMENT, lambda x: L.report_tail(x, "self report"))] == [("options", "4"), ("cost ok", "yes")]
    found = parsed(spark, DOCUMENT, lambda x: L.exhibits(x, "exhibit ", headers))
    assert [(e.section, e.heading, e.rows) for e in found] == [("EVENT SITUATION", "Exhibit A: Sales", [["Month", "Units"], ["May", "12"]]), ("TASKS:", "Exhibit B", [["x", "y"]])]


@pytest.mark.parametrize("text", ["", "   ", "TASKS", "Exhibit", "Q:", "A: only", "Self report", None])
def test_malformed_blocks(spark, text):
    """Headers without a body, answers without a question and null texts give empty results."""
    headers = ["tasks", "self report"]
    assert parsed(spark, text, lambda x: L.section(x, "tasks", headers)) == []
    assert parsed(spark, text, lambda x: L.report_tail(x, "self report")) == [] and parsed(spark, text, L.findings) == []
    assert [tuple(q) for q in parsed(spark, text, L.questions)] == ([("", None)] if text == "Q:" else [])


# Overlays

PART = "cand_id string, area string, answer string, question string, option string"
BASE = [("c1", "Pricing", "A", "why", "x"), ("c2", "Selling", "B", "how", "y"), ("c3", "Selling", "C", "who", "z"), ("c4", "Pricing", "D", "what", "w")]


def repaired(spark, tmp_path, repairs, **options):
    table = Snapshots(spark, f"{tmp_path}/t{random.random()}")
    table.publish(spark.createDataFrame(BASE, PART))
    options.setdefault("gates", {"option": F.length("option") == 0})
    version, wrong = overlay.apply(table, spark.createDataFrame(repairs, PART), "cand_id", ["area", "answer"], ["question", "option"], **options)
    return version, sorted(map(tuple, wrong.collect()), key=repr), sorted(map(tuple, table.read().collect()))


def test_all_repairs_or_none(spark, tmp_path):
    """Letter case is healed, a wrong answer is set to what was assigned; one violation keeps the old snapshot and names its reasons."""
    assigned = spark.createDataFrame([("c2", "D"), ("c3", "C")], "cand_id string, answer string")
    good = [("c1", "PRICING", "A", "why now", "x2"), ("c2", "Selling", "D", "how", "y2")]
    version, wrong, rows = repaired(spark, tmp_path, good, answer="answer", assigned=assigned)
    assert (version, wrong) == (2, []) and rows[:2] == [("c1", "Pricing", "A", "why now", "x2"), ("c2", "Selling", "D", "how", "y2")] and rows[2:] == BASE[2:]
    for bad, reason in [
        (("c3", "Other", "C", "who", "z2"), [("c3", "changes area")]),
        (("c3", "Selling", "A", "who", "z2"), [("c3", "changes answer")]),
        (("c9", "Selling", "A", "q", "o"), [("c9", "without a row")]),
        (("c1", "Pricing", "A", "why", "other"), [("c1", "repaired twice")]),
        (("c3", "Selling", "C", "who", ""), [("c3", "fails option")]),
        ((None, "Selling", "C", "who", "z"), [(None, "without a key")]),
    ]:
        version, wrong, rows = repaired(spark, tmp_path, [*good, bad], answer="answer", assigned=assigned)
        assert version is None and wrong == reason and rows == BASE
    version, wrong, rows = repaired(spark, tmp_path, good, answer="answer", assigned=assigned, expected=spark.createDataFrame([("c1",)], "cand_id string"))
    assert version is None and wrong == [("c2", "out of scope")] and rows == BASE
    assert repaired(spark, tmp_path, good)[1] == [("c2", "changes answer")]


def test_overlay_notes(spark):
    frame = lambda rows: spark.createDataFrame(rows, PART)
    _, wrong, notes = overlay.judged(frame(BASE), frame([("c1", "pricing", "A", "why", "x"), ("c2", "Selling", "D", "how", "y")]), "cand_id", ["area", "answer"], ["question", "option"], answer="answer", assigned=spark.createDataFrame([("c2", "D")], "cand_id string, answer string"))
    assert wrong.count() == 0 and sorted(map(tuple, notes.collect())) == [("c1", "area kept as it was spelt"), ("c2", "answer set to what was assigned")]


# Rotations

POOL = ["north", "south", "east", "west", "up"]


def plain_fresh(rows, pool):
    used, out = {}, {}
    for key, place, seed in sorted(rows):
        counts = used.setdefault(key, Counter())
        at = rotation.start_of(seed, len(pool))
        turned = pool[at:] + pool[:at]
        pick = next((v for v in turned if v not in counts), None) or min(turned, key=lambda v: counts[v])
        counts[pick] += 1
        out[key, place] = pick
    return out


def plain_recent(rows, pool, memory):
    past, out = {}, {}
    for key, place, seed in sorted(rows):
        held = past.setdefault(key, [])
        at = rotation.start_of(seed, len(pool))
        used = held[-memory:] if memory else []
        turned = pool[at:] + pool[:at]
        held.append(next((v for v in turned if v not in used), pool[at]))
        out[key, place] = held[-1]
    return out


def rotated(spark):
    rows = [(k, i, f"{k}:{i}") for k, n in (("a", 83), ("b", 5), ("c", 1), ("d", 12)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, at long, seed string").repartition(3)


def test_fresh_picks_beyond_the_pool(spark):
    rows, frame = rotated(spark)
    got = rotation.fresh_picks(frame, ["key"], [F.col("at")], "seed", POOL).collect()
    assert {(r.key, r.at): r.pick for r in got} == plain_fresh(rows, POOL) and len(got) == len(rows)


@pytest.mark.parametrize("memory, block", [(3, 7), (4, 2), (6, 5), (0, 4), (2, 1024)])
def test_recent_picks_over_blocks(spark, memory, block):
    """Histories longer than the pool, blocks shorter than the memory, and a memory that blocks every value."""
    rows, frame = rotated(spark)
    got = rotation.recent_picks(frame, ["key"], [F.col("at")], "seed", POOL, memory, block).collect()
    assert {(r.key, r.at): r.pick for r in got} == plain_recent(rows, POOL, memory) and len(got) == len(rows)


# Draws


def test_indicators_of_an_event(spark):
    """Counts are exact, no key comes twice, cores are of one area and in it, and areas are drawn in proportion to their weights."""
    draw = random.Random(11)
    weights = {"a": 1.0, "b": 2.0, "c": 5.0, "thin": 9.0}
    listed = [(area, "in" if draw.random() < 0.6 else "near", f"{area} indicator {k} {v}", f"key {k if k % 3 else area + str(k)}") for area in "abc" for k in range(12) for v in range(1 + k % 2)] + [("thin", "in", "t", "key t")]
    events = [(f"e{i}", 7, 3) for i in range(1200)] + [("big", 90, 3), ("none", 3, 40)]
    candidates = spark.createDataFrame(listed, "area string, tier string, pi string, key string").withColumn("weight", F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("area")])
    every = spark.createDataFrame(events, "event string, pi_count int, core_min int")
    got = draws.select_indicators(every, candidates.crossJoin(every.select("event")), 5)
    again = draws.select_indicators(every, candidates.crossJoin(every.select("event")).repartition(7), 5)
    rows = got.collect()
    assert sorted(rows) == sorted(again.collect())
    key_of = {pi: key for _, _, pi, key in listed}
    by = {}
    for r in rows:
        by.setdefault(r.event, []).append(r)
    declared = Counter()
    for event, picked in by.items():
        core = [r for r in picked if r.role == "core"]
        assert len(core) == 3 and len({r.area for r in core}) == 1 and core[0].area != "thin" and all((r.area, "in", r.pi) in {x[:3] for x in listed} for r in core)
        assert len({key_of[r.pi] for r in picked}) == len(picked) and sorted(r.place for r in picked) == list(range(1, len(picked) + 1))
        assert len(picked) == 7 or event == "big"
        declared[core[0].area] += 1
    assert "none" not in by and 7 < len(by["big"]) < 90
    for area, share in (("a", 1 / 8), ("b", 2 / 8), ("c", 5 / 8)):
        assert abs(declared[area] / len(by) - share) < 4 * math.sqrt(share * (1 - share) / len(by))


# The store


def test_only_matching_files_are_opened(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, f"pi-{i % 40}", start + timedelta(minutes=17 * i)) for i in range(3_000)]
    store.write(spark.createDataFrame(rows, "id long, pi string, ts timestamp"), f"{tmp_path}/log")
    whole = spark.read.parquet(f"{tmp_path}/log").inputFiles()
    since, until = start + timedelta(days=3, hours=5), start + timedelta(days=6)
    for pi, a, b in (("pi-7", None, None), (None, since, until), ("pi-7", since, until), ("unknown", None, None), (None, None, None)):
        found = store.read(spark, f"{tmp_path}/log", pi, a, b)
        want = {r[0] for r in rows if (pi is None or r[1] == pi) and (a is None or r[2] >= a) and (b is None or r[2] < b)}
        assert {r.id for r in found.collect()} == want and found.columns == ["id", "pi", "ts"]
        scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line)
        opened = found._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles()
        assert "PartitionFilters: []" not in scan or (pi, a) == (None, None)
        if pi or a:
            assert opened <= len(whole) * (0.15 if pi else 1) * (0.2 if a else 1) + 3
        else:
            assert opened == len(whole)


# Patterns


def test_a_name_is_given_once(spark):
    from lumenbank.functions import patterns

    registry = patterns.Registry()
    registry.add_given("mine=^x")
    for bad in ("mine=y", "longest=y", "nothing", "=x", "open=("):
        with pytest.raises((ValueError, re.error)):
            registry.add_given(bad)
    rows = spark.createDataFrame([(1, {"A": "xx", "B": "x 1", "C": "always so", "D": None})], "id long, options map<string,string>")
    assert sorted((r.letter, r.pattern) for r in registry.find(rows).collect()) == [("A", "mine"), ("B", "mine"), ("B", "only number"), ("C", "absolute"), ("C", "longest")]
    with pytest.raises(KeyError):
        registry.find(rows, ["unknown"])


def test_patterns_mean_what_they_mean_in_sql(spark):
    """Accented letters are no part of a word, only a line feed ends a line, and $ stands at the very end."""
    import duckdb

    from lumenbank.functions import patterns

    registry = patterns.Registry()
    given = {"own": "^th.*e$", "inner": r"\Ball\B", "either": r"^[$\]b]|\$", "lines": r"(?m)^all$", "sigma": "σ"}
    for name, pattern in given.items():
        registry.add_given(f"{name}={pattern}")
    texts = ["éall", "allé", "all_", "_all", "balls", "all", "ALL may", "mİght", "KΑΣ", "the\n", "th\u0085e", "th\re", "th\ne", "th\u2028e", "x\nall", "all\n", "a$", "]", "$", "b", "\\", "може must"]
    rows = spark.createDataFrame([(i, {"A": x, "B": "", "C": "", "D": ""}) for i, x in enumerate(texts)], "id long, options map<string,string>")
    got = {(r.id, r.pattern) for r in registry.find(rows, ["absolute", "hedge", *given]).collect() if r.letter == "A"}
    given |= {"absolute": r"\b(always|never|all|none|only|every|must)\b", "hedge": r"\b(may|might|could|often|usually|sometimes)\b"}
    match = lambda text, pattern: duckdb.execute("SELECT regexp_matches(lower(?), ?)", [text, pattern]).fetchone()[0]
    assert got == {(i, name) for i, x in enumerate(texts) for name, pattern in given.items() if match(x, pattern)}


def test_paragraphs_lose_only_spaces(spark, tmp_path):
    """Characters equal to the paragraph's place stay; spaces go in each paragraph."""
    import __spark_entry__ as entry

    rows = [(1, "0997 a0\n1235 b1\n  22 c  \n   \n\t"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["str26_paragraphs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "0997 a0"), (1, 2, "1235 b1"), (1, 3, "22 c"), (1, 4, "\t")]
