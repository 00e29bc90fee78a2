"""Rows with the awkward cases that the operators must handle."""

import random
import string

CLASHING = "doc_id long, text string, id int, Counts int, body int, kept int, N_words int"


def near_copies(seed: int) -> list[tuple]:
    """Rows (id, text): copies with changes, a chain, a shared passage, and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    hot = [rng.choice(words) for _ in range(20)]
    rows = []
    for k in range(40):
        changed = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            changed[rng.randrange(60)] = rng.choice(words)
        rows.append((k + 5, " ".join(changed)))
    step = list(base)
    for k in range(15):
        step = list(step)
        step[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 + k, " ".join(step)))
    for k in range(30):
        rows.append((2000 + k, " ".join(hot + [rng.choice(words) for _ in range(rng.choice([0, 1, 9]))])))
    rows += [
        (3000, None), (3001, ""), (3002, " \n"), (3003, "A b"), (3004, "a B"), (None, rows[0][1]),
        (None, None), rows[3], (8, rows[50][1]), (1, " ".join(rng.choice(words) for _ in range(5000))),
    ]
    rng.shuffle(rows)
    return rows


def odd_texts(seed: int) -> list[tuple]:
    """Rows (id, text) that share long passages, and texts that are hard to cut."""
    rng = random.Random(seed)
    big = " ".join("".join(rng.choice("abcdeé ") for _ in range(9)) for _ in range(1500))
    solid = "".join(rng.choice("abcde") for _ in range(9000))
    return [
        (0, None), (1, ""), (2, "<|endoftext|> a<|endoftext|>b"), (3, "日本語 テキスト 😀 " * 30), (4, big),
        (5, "x " + big[500:] + " y"), (6, big[:6000] + "\n\n  tail"), (7, solid), (8, "q" + solid),
        (9, "  \n\n " * 400), (None, "no id"), (10, big[3000:9000] + "<|endoftext|>" + big[:7000]),
        (10, "same id"), (11, "\u0085a\x1cb \x1c c" * 300), (12, (big[:4000] + "<|endoftext|>") * 3),
        (13, string.printable * 20), (14, "x"), (14, "x"),
    ]
