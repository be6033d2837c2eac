import random

from shoptrail.operators import orders, sessions

NO_ID = dict(transaction_id=None)


def tuples(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_order_rule_over_sessions_and_users(make_events):
    """One ID in two sessions of a user is one order, of another user another; without an ID only a value makes an order."""
    sent = lambda user, session, at, tid, usd: (user, session, at, "purchase", dict(transaction_id=tid, purchase_revenue_usd=usd))
    events = make_events([
        sent("ana", 10, 40, "K-7", 12.5), sent("ana", 11, 90, "K-7", 12.5), sent("ana", 11, 95, "K-8", 20.0),
        sent("ben", 20, 5, "K-7", 99.0), sent("ben", 20, 6, "", None), sent("ben", 20, 7, "", 3.25), sent("ben", 20, 8, "(not set)", 3.25),
        sent("cem", 30, 1, None, -4.0), sent("cem", 31, 2, "K-9", 0.0), ("dia", 40, 3, "page_view", {}),
    ])
    bought = orders.purchases(events)
    table = sessions.sessions(events, bought)
    assert tuples(table, "ga_session_id", "orders", "revenue_usd", "has_purchase", "has_purchase_event") == [
        (10, 1, 12.5, True, True), (11, 1, 20.0, True, True), (20, 3, 105.5, True, True), (30, 0, 0.0, False, True),
        (31, 1, 0.0, True, True), (40, 0, 0.0, False, False)]
    s = orders.order_summary(bought, table).first()
    assert (s.purchase_events, s.repeats, s.empty, s.orders, s.orders_without_id) == (9, 1, 2, 6, 2)
    assert (s.conversion_orders, s.conversion_raw_events) == (4 / 6, 5 / 6)


def brute_force(rows):
    """(user, session, secs, id, revenue) -> multiset of (row, is_repeat, is_empty, counts)."""
    late = float("inf")
    order = sorted(rows, key=lambda r: (r[2], -r[4] if r[4] is not None else late, r[1] if r[1] is not None else late))
    seen, out = set(), []
    for r in order:
        valid = r[3] not in (None, "", "(not set)")
        repeat = valid and (r[3], r[0]) in seen
        if valid:
            seen.add((r[3], r[0]))
        empty = not valid and (r[4] or 0) <= 0
        out.append((r, repeat, empty, not repeat and not empty))
    return out


def test_flags_equal_brute_force_with_ties_copies_and_a_hot_order(make_events):
    rng = random.Random(7)
    rows = [(f"u{rng.randint(1, 4)}", rng.choice([1, 2, None]), rng.randint(0, 5),
             rng.choice(["A", "B", "", "(not set)", None]), rng.choice([None, 0.0, 10.0, 20.0])) for _ in range(300)]
    rows += [("hot", 1, rng.randint(0, 20), "H", 5.0) for _ in range(200)] + [("copy", 1, 3, "C", 5.0)] * 100
    events = make_events([(u, s, t, "purchase", dict(transaction_id=i, purchase_revenue_usd=v)) for u, s, t, i, v in rows])
    bought = orders.purchases(events)
    flags = orders.purchase_events(bought)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.user_pseudo_id, r.ga_session_id, r.transaction_id, r.purchase_revenue_usd,
                   r.is_repeat, r.is_empty, r.counts_as_order) for r in flags.collect()), key=key)
    want = sorted(((r[0], r[1], r[3], r[4], *f) for r, *f in brute_force(rows)), key=key)
    assert got == want
    assert bought.agg({"n_events": "sum"}).first()[0] == len(rows)
    blocks = orders.purchase_events(bought, block=7)
    assert blocks.exceptAll(flags).isEmpty() and flags.exceptAll(blocks).isEmpty()


def test_a_purchase_without_a_session_is_an_order_but_belongs_to_no_session(make_events):
    events = make_events([("u", None, 1, "purchase", dict(transaction_id="X", purchase_revenue_usd=9.0)),
                          ("u", 1, 2, "page_view", {})])
    bought = orders.purchases(events)
    table = sessions.sessions(events, bought)
    assert bought.first().n_orders == 1
    assert table.count() == 1 and table.first().orders == 0


def test_no_purchases_at_all(make_events):
    events = make_events([("u", 1, 0, "page_view", {})])
    bought = orders.purchases(events)
    s = orders.order_summary(bought, sessions.sessions(events, bought)).first()
    assert (s.purchase_events, s.repeats, s.empty, s.orders, s.orders_without_id, s.conversion_orders) == (0, 0, 0, 0, 0, 0.0)
