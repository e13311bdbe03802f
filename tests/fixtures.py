"""Hand-made event logs (FIXTURES.md H1, H2) as canonical event frames."""

from __future__ import annotations

import datetime as dt

from churnlab.schema import EVENT_SCHEMA

LA = "Los Angeles-Long Beach-Anaheim, CA"
NY = "New York-Newark-Jersey City, NY-NJ-PA"


def ms(text: str) -> int:
    t = dt.datetime.strptime(text, "%Y-%m-%d %H:%M").replace(tzinfo=dt.timezone.utc)
    return int(t.timestamp() * 1000)


def frame(spark, rows):
    """rows: (userId, sessionId, 'YYYY-MM-DD HH:MM' | None, page, gender, location)."""
    data = []
    for i, (user, session, time, page, gender, location) in enumerate(rows):
        data.append((user, session, None if time is None else ms(time), page, i, gender, location, "free", 200))
    return spark.createDataFrame(data, EVENT_SCHEMA)


H1_ROWS = [
    ("a", 1, "2018-10-01 10:00", "Home", "M", LA),
    ("a", 1, "2018-10-01 10:01", "NextSong", "M", LA),
    ("a", 1, "2018-10-01 10:02", "Thumbs Up", "M", LA),
    ("a", 2, "2018-10-02 09:00", "NextSong", "M", LA),
    ("a", 2, "2018-10-02 09:00", "NextSong", "M", LA),
    ("a", 2, "2018-10-02 09:00", "Thumbs Up", "M", LA),
    ("a", 2, "2018-10-02 09:05", "NextSong", "M", LA),
    ("a", 3, "2018-10-05 20:00", "Error", "M", LA),
    ("a", 3, "2018-10-06 08:00", "NextSong", "M", LA),
    ("a", 4, "2018-11-01 12:00", "NextSong", "M", LA),
    ("a", 4, "2018-11-01 12:03", "Downgrade", "M", LA),
    ("a", 4, "2018-11-02 00:05", "Home", "M", LA),
    ("b", 5, "2018-10-03 00:00", "Home", "F", NY),
    ("b", 5, "2018-10-03 00:10", "Thumbs Down", "F", NY),
]


def h1(spark):
    return frame(spark, H1_ROWS)


def h2(spark):
    rows = [
        (None, 1, "2018-10-01 10:00", "NextSong", "M", LA),  # null user
        ("", 1, "2018-10-01 10:00", "NextSong", "M", LA),  # blank user
        ("c", 7, None, "NextSong", "F", LA),  # null ts
        ("c", 7, "2018-10-01 11:00", None, "F", None),  # null page, null location
        ("c", 7, "2018-10-01 11:05", "NextSong", None, "A"),  # null gender, one-char location
        ("solo", 8, "2018-10-01 12:00", "Home", "M", LA),  # one event
    ]
    # "late": first listen after ten other events -> those ten fill 0
    for i in range(10):
        rows.append(("late", 9, f"2018-10-0{1 + i // 4} 1{i % 4}:00", "Home", "F", NY))
    rows.append(("late", 9, "2018-10-04 10:00", "NextSong", "F", NY))
    # "tail": a listen followed by nine other events over three days;
    # the first seven get the listen's count, the last two get 0.
    rows.append(("tail", 10, "2018-10-01 23:50", "NextSong", "M", LA))
    for t in ("2018-10-01 23:51", "2018-10-01 23:52", "2018-10-02 00:01", "2018-10-02 00:02",
              "2018-10-02 00:03", "2018-10-02 00:04", "2018-10-04 09:00", "2018-10-04 09:01",
              "2018-10-04 09:02"):
        rows.append(("tail", 10, t, "Home", "M", LA))
    return frame(spark, rows)
