"""Rows of a frame and of SQL in a form that can be compared."""


def plain(row):
    return tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in row)


def same(frame, duck, sql):
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    place = [names.index(c) for c in frame.columns]
    want = sorted(repr(plain(r[i] for i in place)) for r in found.fetchall())
    assert sorted(repr(plain(r)) for r in frame.collect()) == want
