"""Odd rows and an order for results with nulls."""
LONG = "Lorem ipsum dolor, sit amet. " * 4000
TEXTS = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two three four five six seven eight nine ten eleven twelve"), (5, LONG),
         (5, LONG), (6, "one two three four five six seven eight nine ten eleven twelve"), (7, "<|endoftext|> a  b\n\n\nc é　x \x1c ###"),
         (None, "a line\nanother line\na third line\n"), (None, None), (8, "a line\nanother line\na third line\nand an end")]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
