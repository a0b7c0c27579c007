"""Decisions in the order of a batch, against a loop over its drafts."""

import numpy as np
import pytest

from civicfeed.operators import dedup


def in_turn(drafts, events, duplicate=dedup.DUPLICATE, update=dedup.UPDATE):
    """Each draft after the other: (id, action, match, score of the match)."""
    known, out = list(events), []
    for d in sorted(drafts):
        i, source, message, title, body, address, v = d
        same = [e[0] for e in known if message is not None and e[1:3] == (source, message)]
        if same:
            out.append((i, "duplicate", max(same), None))
            continue
        x, best = np.array(v) / max(np.linalg.norm(v), 1e-12), (None, None)
        for e in known:
            if address is None or e[5] is None or e[5] == address:
                s = round(float(x @ np.array(e[6]) / max(np.linalg.norm(e[6]), 1e-12)), 9)
                best = max(best, (s, e[0]), key=lambda b: (-9, 0) if b[0] is None else b)
        s, hint = best[0], "устранена" in body
        action = "new"
        if s is not None and s >= duplicate:
            action = "update" if hint and s < dedup.CERTAIN else "duplicate"
        elif s is not None and s >= update and (hint or s >= (duplicate + update) / 2):
            action = "update"
        if action == "new":
            known.append(d)
        out.append((i, action, best[1] if action != "new" else None, s if action != "new" else None))
    return out


SCHEMA = "id long, source string, source_msg_id string, title string, body string, address_id long, v array<double>"


@pytest.mark.parametrize("n,block", [(2000, 4096), (300, 37)])
def test_batch_against_a_loop(spark, n, block, monkeypatch):
    """Chains on an arc, near copies, equal copies, messages that come again, addresses that conflict."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 12, 6))

    def row(i):
        kind = i % 5
        if kind == 0:  # an arc: each is like those just before
            v = [float(np.cos(i / 40)), float(np.sin(i / 40)), 0.0, 0.0, 0.0, 0.0]
        elif kind == 1:  # copies
            v = centres[i % 7].tolist()
        else:
            v = (centres[rng.integers(len(centres))] + rng.normal(0, 0.35, 6)).tolist()
        message = None if i % 4 == 0 else f"m{i % 11 if i % 13 == 0 else i}"
        return (i, "news", message, None, "авария устранена" if i % 6 == 0 else "вода", None if i % 3 else int(rng.integers(3)), v)

    events, drafts = [row(i) for i in range(1, 40)], [row(i) for i in range(100, 100 + n)]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (drafts, events)]
    if block != 4096:
        meet = dedup._meet
        monkeypatch.setattr(dedup, "_meet", lambda a, b, _, choose: meet(a, b, block, choose))
    got = sorted((r.id, r.action, r.match_id, r.score if r.action != "new" else None) for r in dedup.resolve_batch(*frames).collect())
    want = in_turn(drafts, events)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)
    assert len({a for _, a, _, _ in got}) == 3


def test_batch_without_rows(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(5, None, None, None, "вода", None, [1.0, 0.0])], SCHEMA)
    assert dedup.resolve_batch(none, one).isEmpty()
    assert [(r.id, r.action) for r in dedup.resolve_batch(one, none).collect()] == [(5, "new")]
