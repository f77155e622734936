"""A four-team league over three seasons, with deliberate edge cases."""

from __future__ import annotations

import random

from weekcast import schema
from weekcast.plans.features import Sources

TEAMS = ["AAA", "BBB", "CCC", "DDD"]
SEASONS = [2023, 2024, 2025]
WEEKS = range(1, 7)
PLAYERS = {t: {"QB": [f"{t}-q1", f"{t}-q2"], "RB": [f"{t}-r1", f"{t}-r2"],
               "WR": [f"{t}-w1", f"{t}-w2", f"{t}-w3"], "TE": [f"{t}-t1"]} for t in TEAMS}
NAMES = [f.name for f in schema.PLAYS.fields]


def games(season: int, week: int):
    """Two games a week; in week 3 only one, so two teams are on bye."""
    order = TEAMS if week % 2 else [TEAMS[0], TEAMS[2], TEAMS[1], TEAMS[3]]
    pairs = [(order[0], order[1]), (order[2], order[3])]
    return pairs[:1] if week == 3 else pairs


def play_rows(seed: int = 7, after: tuple[int, int] | None = None, change=None):
    rng = random.Random(seed)
    rows = []
    for season in SEASONS:
        for week in WEEKS:
            for home, away in games(season, week):
                for off, dfn in ((home, away), (away, home)):
                    for i in range(24):
                        rows.append(_play(rng, season, week, off, dfn, i))
    if change:
        rows = [change(dict(zip(NAMES, r))) if (r[0], r[1]) >= after else r for r in rows]
        rows = [tuple(r[n] for n in NAMES) if isinstance(r, dict) else r for r in rows]
    return rows


def _play(rng, season, week, off, dfn, i):
    mine = PLAYERS[off]
    kind = rng.choice(["pass", "pass", "run", "no_play"])
    qb = mine["QB"][0] if rng.random() < 0.9 else mine["QB"][1]
    passer = rusher = receiver = None
    if kind == "pass":
        passer = None if i == 5 else qb
        receiver = None if i == 9 else rng.choice(mine["WR"] + mine["TE"] + mine["RB"][:1])
        if off == "AAA" and season == 2024 and receiver == "AAA-w3":
            receiver = None                       # skips a whole season
        if off == "BBB" and week > 3 and receiver == "BBB-w3":
            receiver = "CCC-w9"                   # appears for another team mid-season
    elif kind == "run":
        rusher = None if i == 5 else rng.choice(mine["RB"] + [qb])
    elif i == 3:
        passer = qb                               # named on a play outside the box score
    name = lambda p: None if p is None else p.upper()
    yards = None if rng.random() < 0.05 else float(rng.randint(-3, 40))
    flag = lambda p: float(rng.random() < p)
    return (
        season, week, kind, off, dfn, passer, name(passer), rusher, name(rusher),
        receiver, name(receiver), float(kind == "pass"), flag(0.6), float(kind == "run"), yards,
        flag(0.1), flag(0.1), flag(0.05), flag(0.1), float(kind == "pass"),
        float(rng.randint(1, 50)), 0.0 if week == 5 else (
            float(rng.randint(1, 30)) if receiver else None))


def schedule_rows():
    rows = []
    for season in SEASONS:
        for week in WEEKS:
            for k, (home, away) in enumerate(games(season, week)):
                spread = None if week == 2 and k == 1 else float(week - 3 + k)
                line = {None: None}.get(spread, -150.0 if spread and spread > 0 else 130.0)
                roof = ["outdoors", "dome", "closed", "open"][(week + k) % 4]
                rows.append((season, week, f"{season}-09-{week * 4 + k:02d}", home, away, spread,
                             None if week == 4 else 44.0 + week, line, None if line is None
                             else -line, roof, None if week == 6 else 20.0 + 10 * k,
                             None if week == 6 else 14.0 + week, f"{home}-q1", f"{away}-q1"))
    return rows


def make_sources(spark, plays=None) -> Sources:
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    everyone = [(p, pos, t) for t, groups in PLAYERS.items()
                for pos, ids in groups.items() for p in ids]
    rosters = [(p, f"pfr-{p}" if not p.endswith("2") else None,
                "FB" if p.endswith("r2") else pos, s, t, p.title())
               for s in SEASONS for p, pos, t in everyone if p != "AAA-w2"]
    rosters += [(None, "pfr-nobody", "WR", 2025, "AAA", "Nobody")]
    snaps = [(f"pfr-{p}", s, w, (len(p) + w + s) % 10 / 10.0)
             for s in SEASONS for w in WEEKS for p, _, _ in everyone]
    snaps += [("pfr-AAA-q1", 2025, 1, 0.95)]
    injuries = [("BBB-w1", 2025, w, "Out" if w % 2 else "Questionable") for w in WEEKS]
    injuries += [("CCC-w1", 2024, 2, "Doubtful"), (None, 2024, 2, "Out")]
    weekly = [(p, s, w, "Offense", pos, "x" if w == 4 else str(1 + int(p[-1] != "1")))
              for s in SEASONS[:2] for w in WEEKS for p, pos, _ in everyone if w != 5]
    weekly += [("AAA-q2", 2023, 1, "Defense", "QB", "1")]
    snapshots = []
    for p, pos, _ in everyone:
        rank = 1 + int(p[-1] != "1")
        snapshots += [(p, f"2025-09-{d:02d}T07:30:00Z", pos, rank) for d in (4, 9, 20)]
    snapshots = [r for r in snapshots if not (r[0] == "DDD-q1" and r[1] < "2025-09-20")]
    snapshots += [("AAA-r2", "2025-09-08T07:00:00Z", "RB", 1), (None, "2025-09-04T00:00:00Z", "QB", 1)]
    return Sources(
        frame(play_rows() if plays is None else plays, schema.PLAYS),
        frame(schedule_rows(), schema.SCHEDULES), frame(snaps, schema.SNAP_COUNTS),
        frame(injuries, schema.INJURIES), frame(rosters, schema.ROSTERS),
        frame(weekly, schema.DEPTH_WEEKLY), frame(snapshots, schema.DEPTH_SNAPSHOTS))
