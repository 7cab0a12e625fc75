"""Gates on authored rows and batches against plain loops, and the rules that fixtures pin."""

import random
import re
from collections import Counter, defaultdict

from lumenbank.operators import authored, harvest
from lumenbank.sources.adapters import LETTERS

ROW = "cand_id string, file string, question string, options map<string,string>, answer string, difficulty string, explanation string, pi string, area string"


def row(i, question, options, answer="A", difficulty="easy", file="f"):
    return i, file, question, dict(zip(LETTERS, options)), answer, difficulty, "Because.", "some pi", "Selling"


def norm(s):
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"-([0-9])", r"neg \1", s.lower())).strip()


def plain_batch(rows, want=None):
    found = set()
    files = defaultdict(set)
    for r in rows:
        files[r[0]].add(r[1])
    where = defaultdict(set)
    for i, file, question, options, answer, difficulty, *rest in rows:
        say = lambda level, what, i=i: found.add((i, level, what))
        texts = [options[x] for x in LETTERS]
        bad = []
        bad += ["empty option"] if any(not t.strip() for t in texts) else []
        full = [norm(t) for t in texts if norm(t)]
        bad += ["same options"] if len(set(full)) < len(full) else []
        bad += ["no such key"] if answer not in LETTERS else []
        bad += ["no such tier"] if difficulty not in ("easy", "medium", "hard") else []
        bad += [f"empty {n}" for n, v in zip(("question", "explanation", "pi", "area"), (question, *rest)) if not (v or "").strip()]
        for b in bad:
            say("hard", b)
        for t in full:
            if len(t) >= 18:
                where[t].add(i)
        if want is not None:
            if len(files[i]) > 1:
                say("hard", "id in several files")
            elif i in want and answer != want[i]:
                say("hard", "answer is not the assigned letter")
        if bad:
            continue
        key = options[answer]
        figures = lambda s: {x.replace(",", "") for x in re.findall(authored.FIGURE, s)}
        if any(len(x.replace(".", "")) >= 2 for x in figures(key) & figures(question)):
            say("soft", "key shares a figure with its stem")
        dec = [bool(re.search(authored.DECIMAL, t)) for t in texts]
        if sum(dec) in (1, 3) and dec[LETTERS.index(answer)] == (sum(dec) == 1):
            say("soft", "key is the odd one by its decimal")
        places = []
        for t in texts:
            numbers = re.findall(authored.FIGURE, t)
            places.append(len(numbers[0].partition(".")[2].rstrip("0")) if len(numbers) == 1 else None)
        if None not in places and places.count(min(places)) == 1 and places[LETTERS.index(answer)] == min(places):
            say("soft", "key is the roundest number")
        articles = [(re.search(authored.ARTICLE, t.lower()) or [None, ""])[1] for t in texts]
        if any(articles):
            say("soft", "an article before a number")
        if all(articles) and len(set(articles)) == 2 and Counter(articles)[articles[LETTERS.index(answer)]] == 1:
            say("soft", "the article names the key")
    for ids in where.values():
        if len(ids) > 1:
            found |= {(i, "hard", "an option is another row's too") for i in ids}
    return found


def test_batches(spark):
    draw = random.Random(5)
    phrases = ["A $80 fee", "an $80 fee", "An 18% rate", "a 5% rate", "12.50", "12.5", "7", "1,200.00", "the carrier should make this decision", "The carrier should make this decision!", "short", "", "  ", "costs 40", "costs 3.25"]
    rows = [row(f"c{i % 180}", draw.choice(["Of 1,200 units?", "Costs 40 or 7?", "none", ""]), draw.choices(phrases, k=4), draw.choice("ABCDE"), draw.choice(["easy", "hard", "odd"]), f"f{i // 180}") for i in range(200)]
    want = {f"c{i}": draw.choice("ABCD") for i in range(150)}
    payload = spark.createDataFrame(list(want.items()), "cand_id string, want_answer string")
    frame = spark.createDataFrame(rows, ROW)
    assert {tuple(r) for r in authored.check_batch(frame, payload).collect()} == plain_batch(rows, want)
    assert {tuple(r) for r in authored.check_batch(frame).collect()} == plain_batch(rows)


def test_texts_are_matched_once(spark):
    """Each pattern of a batch's gates is looked for once in each option, not again for each gate and each other option."""
    plan = authored.check_batch(spark.createDataFrame([row("c", "Of 2?", ["a 1", "b", "c", "d"])], ROW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^a-z0-9]+") <= 12 and plan.count(r"\d[\d,]*") <= 5 and plan.count(r"\b(an?)") <= 4


def test_options_whose_plain_text_is_longer(spark):
    """A minus before a digit becomes a word: eleven characters may make eighteen."""
    rows = [row("a", "x", ["-1 -2 -3 -4", "b", "c", "d"]), row("b", "x", ["-1,-2,-3,-4", "e", "f", "g"]), row("c", "x", ["twelve chars", "TWELVE CHARS!", "c", "d"])]
    got = {tuple(r) for r in authored.check_batch(spark.createDataFrame(rows, ROW)).collect()}
    assert got == plain_batch(rows) and ("a", "hard", "an option is another row's too") in got


def test_contamination_between_rows(spark):
    """One option text in two well-formed rows blocks both; shorter texts and the same text within one row don't."""
    shared = "The manager should let the insurance carrier make this decision"
    rows = [row("m48", "Surplus cash?", ["Higher return and risk", shared, "The same real risk", "Always the better choice"]), row("m57", "A slow leak?", ["Report it", shared.upper() + "!", "Ignore it", "Sell the tank"]), row("m60", "Else?", ["Report it", "b", "c", "d"])]
    got = {tuple(r) for r in authored.check_batch(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {("m48", "hard", "an option is another row's too"), ("m57", "hard", "an option is another row's too")}


def test_promotions_and_conflicts(spark):
    """Two cases put an indicator in, a published line promotes a near one, and a library line that the corpus has elsewhere goes."""
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    corpus = frame([("1", "fin", "Save.", "save"), ("2", "fin", "Save", "save"), ("2", "fin", "Save", "save"), ("2", "fin", "Spend", "spend"), ("3", "fin", "Lend", "lend"), ("3", "mkt", "Sell", "sell"), ("3", "mkt", "Save", "save")], "case area pi key")
    library = frame([("fin", "Old", "old"), ("ops", "Sell", "sell"), ("ops", "Ship", "ship"), ("ops", "Ship!", "ship")], "area pi key")
    published = frame([("fin", "Spend wisely", "spend"), ("fin", "Save more", "save"), ("fin", "Give", "give")], "area pi key")
    got = sorted(map(tuple, harvest.merge(corpus, library, published).collect()))
    assert got == sorted([
        ("fin", "save", "Save", "in", "corpus"), ("fin", "lend", "Lend", "near", "corpus"), ("fin", "spend", "Spend wisely", "in", "published"), ("fin", "give", "Give", "in", "published"),
        ("mkt", "sell", "Sell", "near", "corpus"), ("mkt", "save", "Save", "near", "corpus"), ("ops", "ship", "Ship", "in", "library"),
    ])
    assert [(r.area, r.key, r.homes) for r in harvest.conflicts(corpus, library).collect()] == [("ops", "sell", ["mkt"])]
    lists = harvest.merge(corpus, library, published)
    quotas = spark.createDataFrame([("e", "fin", 3), ("e", "mkt", 1), ("e", "none", 1)], "event string, area string, core_min int")
    assert sorted(map(tuple, harvest.starved(lists, quotas).collect())) == [("e", "mkt", 0, 1), ("e", "none", 0, 1)]
