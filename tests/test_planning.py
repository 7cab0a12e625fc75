"""The day's plan of each user against a plain loop over random users."""

import random

from lumenbank.operators import planning as P

LOG = "user_id long, session_id string"


def plain(users, stats, areas, custom, frozen, dismissed, available, quizzes, sessions, log, misses, bank_total):
    out = set()
    for u in users:
        uid, tries, ready, pace, days = u
        mine = [s for s in stats if s[0] == uid]
        cold, behind = tries < 12, pace == "behind"
        fresh = [("warmup", "warmup", None, None, 10, None)] if cold else []
        weak = sorted((s for s in mine if s[5] and s[4] < 0.6), key=lambda s: (round(s[4], 9), *s[1:4]))
        fresh += [(f"weak-{s[1]}/{s[3]}", "weak-drill", s[1], s[3], 8, None) for s in weak[: 3 if behind else 2]]
        of_area = {(a[1], a[2]): a[3] if a[4] else 1.0 for a in areas if a[0] == uid}
        unseen = sorted((s for s in mine if not s[5]), key=lambda s: (round(of_area[s[1], s[2]], 9), *s[1:4]))
        fresh += [(f"cover-{s[1]}/{s[3]}", "coverage", s[1], s[3], 3, None) for s in unseen[: 0 if cold else 2 if behind else 1]]
        if not cold and ready >= 0.6:
            fresh.append(("challenge", "challenge", None, None, 10, None))
        if not cold and (days is not None and days <= 10 or ready >= 0.75):
            fresh.append(("milestone", "milestone", None, None, 50, None))
        form = lambda rows: [(r[1], r[2], r[3], r[5], r[6], r[7]) for r in sorted(rows, key=lambda r: (r[8], r[1])) if r[0] == uid]
        pinned, own = form(frozen), form(custom)

        def made(t):
            task, kind, cluster, pi, size, ids = t
            if kind == "fix-misses":
                total = len(ids or [])
                open_ = sum(any(m[0] == uid and m[1] == q and not m[2] for m in misses) for q in ids or [])
                return task, kind, pi, total, total - open_
            if kind in ("weak-drill", "coverage"):
                there = [n for c, p, n in available if (c, p) == (cluster, pi)]
                size = min([size, *there])
            elif kind in P.SIZES:
                size = min(size, bank_total)
            stored = [n for a, b, n in quizzes if (a, b) == (uid, task)]
            total = stored[0] if stored and stored[0] > 0 else size
            ids = {s for a, b, s in sessions if (a, b) == (uid, task)}
            return task, kind, pi, total, min(sum(a == uid and s in ids for a, s in log), total)

        key = lambda t: t[0] if t[1] == "fix-misses" else (t[1], t[2], t[3]) if t[3] else t[1]
        keys = {key(t) for t in own}
        mine_made = [m for m in map(made, own) if m[3] > 0]
        rest = [made(t) for t in (pinned or fresh) if (uid, t[0]) not in dismissed and key(t) not in keys]
        rest = [m for m in rest if m[3] > 0][: max(0, 5 - len(mine_made))]
        for k, m in enumerate(mine_made + rest):
            out.add((uid, k + 1, *m, m[4] >= m[3], k < len(mine_made)))
    return out


def test_plans_of_random_users(spark):
    draw = random.Random(9)
    users, stats, areas, custom, frozen = [], [], [], [], []
    dismissed, quizzes, sessions, log, misses = set(), [], [], [], []
    for u in range(120):
        users.append((u, draw.randrange(30), draw.choice([0.2, 0.6, 0.7, 0.75, 0.9]), draw.choice(["behind", "ahead", "on track", None]), draw.choice([None, 3, 10, 11, 60])))
        for c in "ab":
            for a in range(3):
                areas.append((u, c, f"r{a}", draw.randrange(10) / 10, draw.randrange(3)))
                stats += [(u, c, f"r{a}", f"p{a}{k}", draw.randrange(10) / 10, draw.random() < 0.7) for k in range(3)]
        names = ["warmup", "challenge", "milestone", *[f"{w}-{c}/p{a}{k}" for w in ("weak", "cover") for c in "ab" for a in range(3) for k in range(3)], "m1", "own1"]
        dismissed |= {(u, draw.choice(names)) for _ in range(draw.randrange(3))}
        specs = [("m1", "fix-misses", None, None, None, 4, ["q1", "q2", "q3"][: draw.randrange(4)]), ("own1", "weak-drill", "a", "r0", f"p0{draw.randrange(3)}", 8, None), ("own2", "challenge", None, None, None, 10, None), ("own3", "review", None, None, None, 6, None)]
        custom += [(u, *s, k) for k, s in enumerate(draw.sample(specs, draw.randrange(4)))]
        if draw.random() < 0.3:
            frozen += [(u, *s, k) for k, s in enumerate([("weak-a/p00", "weak-drill", "a", "r0", "p00", 8, None), ("milestone", "milestone", None, None, None, 50, None), ("m2", "fix-misses", None, None, None, 2, ["q1", "q9"])])]
        quizzes += [(u, n, draw.randrange(6)) for n in draw.sample(names, 4)]
        sessions += [(u, draw.choice(names), f"s{draw.randrange(5)}") for _ in range(6)]
        log += [(u, f"s{draw.randrange(6)}") for _ in range(draw.randrange(12))]
        misses += [(u, f"q{k}", draw.random() < 0.5) for k in range(1, 4) if draw.random() < 0.8]
    available = [(c, f"p{a}{k}", draw.randrange(9)) for c in "ab" for a in range(3) for k in range(3) if draw.random() < 0.8]
    frame = spark.createDataFrame
    fresh = P.recommended(frame(users, "user_id long, tries int, readiness double, pace string, days_left int"), frame(stats, "user_id long, cluster string, area string, pi string, mastery double, seen boolean"), frame(areas, "user_id long, cluster string, area string, mastery double, seen int"))
    got = P.day_plan(
        fresh, frame(custom, f"{P.SPEC}, within int"), frame(frozen, f"{P.SPEC}, within int"), frame(list(dismissed), "user_id long, task_id string"), frame(available, "cluster string, pi string, n int"),
        frame(quizzes, "user_id long, task_id string, n int"), frame(sessions, "user_id long, task_id string, session_id string"), frame(log, LOG), frame(misses, "user_id long, question_id string, resolved boolean"), 40,
    ).collect()
    want = plain(users, stats, areas, custom, frozen, dismissed, available, quizzes, sessions, log, misses, 40)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
