"""Every form that the network of op2 is trained on, at every offset of its windows."""

import random
from collections import Counter

from gristmill.llm import private


def test_trained_forms_are_found_at_every_offset():
    r = random.Random(77)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdfghilmnoprstuvé") for _ in range(r.randint(2, 9)))
    forms = [("email", f"{word()}{dot}{word()}{at}{word()}.{end}") for at in (" @ ", " [@] ", "(@)") for dot in (".", "_", "") for end in ("org", "example")]
    forms += [("card", sep.join(num(4) for _ in range(4))) for sep in "./" for _ in range(3)]
    for lead in ("", f"00{num(2)} "):
        forms += [("phone", lead + f) for f in (f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}")]
    forms.append(("phone", "555.010.9999"))
    forms.append(("email", "anna @ mail.net"))
    texts, want = [], []
    for kind, form in forms:
        assert not private.rule_spans(form)[kind]
        for offset in range(64):
            before = ""
            while len(before) < 200 + offset:
                before += word() + " "
            before = before[: 199 + offset] + " "
            texts.append(before + form + " " + " ".join(word() for _ in range(30)))
            want.append((kind, len(before), len(before) + len(form)))
    found = private.model_spans(private.default_tagger(), texts)
    whole, exact = Counter(w[0] for w in want), Counter(w[0] for w, f in zip(want, found) if w in f)
    assert all(exact[k] >= 0.95 * n for k, n in whole.items()), (exact, whole)
    # each form, not only each kind
    by_form = Counter()
    for i, (w, f) in enumerate(zip(want, found)):
        by_form[i // 64] += w in f
    assert min(by_form[i] for i in range(len(forms))) >= 48
    assert sum(len(f) > 1 for f in found) <= 0.01 * len(found)
