"""Documents with nulls, empty and long texts, repeated ids and rows, and clashing columns."""

LONG = "lorem ipsum dolor sit amet " * 12_000
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, LONG), (6, LONG + "end"), (4, "b c d e f"), (None, "no id"),
    (None, None), (7, "twice the same text"), (8, "twice the same text"), (8, "twice the same text"),
    (9, "Ünïcode ß 日本   x"), (10, "12 34 !! ?"),
]
CLASH = ["id", "row", "h", "n", "key", "gram", "score", "lang", "kept", "cluster", "length", "host", "held_out"]
