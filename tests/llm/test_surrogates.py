"""op9 against a plain version of its rules: documents of known pieces, surrogates by hashlib, collisions in sets."""

import hashlib
import random
import re

from driftmark.llm import pii, queries

KEY = queries.PUBLIC_KEY
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def luhn(body):
    total = sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed([int(c) for c in body])))
    return body + str(-total % 10)


def iban(rng):
    account = "".join(rng.choice(DIGITS) for _ in range(18))
    return f"DE{98 - int(account + '131400') % 97:02d}{account}"


def national(kind, canon):
    return canon.replace("+", "")[-10:] if kind == "phone" else canon


def drawn(value, byte, keep=0):
    hexadecimal = re.fullmatch(r"(?=.*[a-f])[0-9a-f]{8,}", value)
    out = ""
    for k, c in enumerate(value):
        own = DIGITS + "abcdef" if hexadecimal else next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)
        out += c if k < keep or own is None else own[byte(k) % len(own)]
    return out


def surrogate(kind, canon, attempt):
    seed = f"{KEY}|{kind}|{canon}|{attempt}"
    canon = national(kind, canon)
    stream = b"".join(hashlib.sha512(f"{seed}|{k}".encode()).digest() for k in range(len(canon) // 64 + 1))
    byte = stream.__getitem__
    value = drawn(canon, byte, {"access": 4, "iban": 2}.get(kind, 0))
    if kind == "card":
        value = luhn(canon[0] + value[1:-1])
    elif kind == "phone" and len(canon) == 10:
        value = str(byte(60) % 8 + 2) + value[1:3] + ("555" if canon[3:6] == "555" and attempt < 4 else value[3:6]) + value[6:]
    elif kind == "ip":
        value = f"{byte(0) % 16 + 240}.{byte(1)}.{byte(2)}.{byte(3) % 254 + 1}"
    elif kind == "email":
        user, domain = canon.split("@")
        value = f"{drawn(user, byte)}@{domain if re.search(r'(^|[.])example[.](com|net|org)$', domain) else 'example.org'}"
    elif kind.startswith("name-"):
        script = "cyrillic" if re.search("[а-я]", canon) else "latin"
        own = pii.SYLLABLES[script]
        value = "".join(own[byte(k) % len(own)] for k in range(3)) + pii.ENDINGS[script][kind[-1]]
    if attempt < pii.ATTEMPTS:
        return value
    mark = hashlib.sha256(seed.encode())
    if kind in ("phone", "card", "ssn"):
        return value + "".join(str(b % 10) for b in mark.digest()[:16])
    return mark.hexdigest()[:16] + value if kind == "email" else value + mark.hexdigest()[:16]


def assign(entities):
    """The surrogate of each (kind, canon), all of them at hand at once."""
    ends = {}
    for kind, canon in entities:
        if kind == "phone" and canon.startswith("+"):
            ends.setdefault(national(kind, canon), []).append(canon)
    same = {(k, c): (k, ends[national(k, c)][0]) for k, c in entities if k == "phone" and not c.startswith("+") and len(ends.get(national(k, c), [])) == 1}
    rest = {e for e in entities if e not in same}
    taken, out = {(k, national(k, c)) for k, c in rest}, {}
    for attempt in range(pii.ATTEMPTS + 1):
        bids = {}
        for kind, canon in rest:
            bid = (kind, surrogate(kind, canon, attempt))
            if bid not in taken or attempt == pii.ATTEMPTS:
                bids.setdefault(bid, []).append(canon)
        for (kind, value), canons in bids.items():
            out[kind, min(canons)] = value
            taken.add((kind, value))
        rest -= out.keys()
    return out | {e: out[whole] for e, whole in same.items()}


def placed(surface, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in surface) + "".join(left)


def cased(name, surface):
    return name.upper() if surface.isupper() else name if surface.islower() else name.title()


def pieces(rng):
    """(surface, kind, parts): what texts are made of; parts are the entities (kind, canon) in it."""
    word = lambda n, a=LOWER: "".join(rng.choice(a) for _ in range(n))
    out = [(word(rng.randrange(2, 9), "abcdefgh"), "plain", []) for _ in range(40)]
    for k in range(12):
        mail = f"{word(3)}.{word(2, DIGITS)}@{rng.choice(['mail.example.com', 'host.test', 'example.net'])}"
        out += [(s, "email", [("email", mail)]) for s in (mail, mail.upper())]
        last = word(3, "23456789") + (rng.choice(["555", "241"])) + word(4, DIGITS)
        out += [(f"+1 ({last[:3]}) {last[3:6]}-{last[6:]}", "phone", [("phone", "+1" + last)]), (f"{last[:3]}-{last[3:6]}-{last[6:]}", "phone", [("phone", last)])]
        card = luhn("4" + word(14, DIGITS))
        out += [(s, "card", [("card", card)]) for s in (card, "-".join(card[i : i + 4] for i in range(0, 16, 4)))]
        out.append((card[:-1] + str((int(card[-1]) + 1) % 10), "plain", []))
        account = iban(rng)
        out += [(account, "iban", [("iban", account)]), (account[:-1] + str((int(account[-1]) + 1) % 10), "plain", [])]
        ssn, ip, access = f"{word(3, DIGITS)}-{word(2, DIGITS)}-{word(4, DIGITS)}", ".".join(str(rng.randrange(1, 224)) for _ in range(4)), "AKIA" + word(16, UPPER + DIGITS)
        out += [(ssn, "ssn", [("ssn", ssn.replace("-", ""))]), (ip, "ip", [("ip", ip)]), (access, "access", [("access", access)])]
        value = rng.choice([word(18, DIGITS + "abcdef"), word(9, LOWER + UPPER + DIGITS), word(70, LOWER)])
        out.append((f"{rng.choice(['password=', 'api_key: ', 'TOKEN = '])}{value}", "secret", [("secret", value)]))
        title, gender = rng.choice([("Mrs.", "f"), ("Mr.", "m"), ("Dr.", "n"), ("г-жа", "f")])
        given, family = (word(5, "абвгде"), word(6, "абвгде")) if title == "г-жа" else (word(5), word(6))
        out.append((f"{title} {given.title()} {family.title()}", "name", [(f"name-{gender}", given), ("name-s", family)]))
        out += [(s, "bare", [("name-s", family)]) for s in (family, family.upper(), family.title())]
    out += [(f"{k}@example.com", "email", [("email", f"{k}@example.com")]) for k in range(6)]  # six for four free surrogates
    return out


def written(surface, kind, parts, made):
    if kind == "phone":
        digits = re.sub("[^0-9]", "", surface)
        return placed(surface, digits[: max(len(digits) - 10, 0)] + made[parts[0]])
    if kind in ("card", "ssn"):
        return placed(surface, made[parts[0]])
    if kind == "secret":
        return surface[: -len(parts[0][1])] + made[parts[0]]
    if kind == "name":
        title, *names = surface.split(" ")
        return " ".join([title, *(cased(made[p], n) for p, n in zip(parts, names, strict=True))])
    return cased(made[parts[0]], surface) if kind == "bare" else made[parts[0]]


def test_surrogates_are_those_of_the_plain_version(spark, tmp_path):
    rng = random.Random(41)
    own = pieces(rng)
    docs = [[rng.choice(own) for _ in range(rng.randrange(1, 25))] for _ in range(150)] + [[p] for p in own if p[1] != "bare"]
    docs.append([own[0]] * 30_000 + [p for p in own if p[1] == "email"])
    known = [{e for _, kind, parts in d if kind == "name" for e in parts} for d in docs]
    live = [[(s, kind if kind != "bare" or parts[0] in k else "plain", parts) for s, kind, parts in d] for d, k in zip(docs, known, strict=True)]
    made = assign({e for d in live for _, kind, parts in d if kind != "plain" for e in parts})
    want = {}
    for k, d in enumerate(live):
        want[k] = (" ; ".join(s if kind == "plain" else written(s, kind, parts, made) for s, kind, parts in d), any(kind != "plain" for _, kind, _ in d))
    texts = {k: " ; ".join(s for s, _, _ in d) for k, d in enumerate(docs)} | {len(docs): None, len(docs) + 1: ""}
    want |= {len(docs): (None, False), len(docs) + 1: ("", False)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.replaced) for r in queries.op9_pii_surrogates(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k], texts[k]) for k in got if got[k] != want[k]} == {}
    # distinct entities stay distinct, and no surrogate occurs
    own = {(k, c): v for (k, c), v in made.items() if k != "phone" or c.startswith("+")}
    assert len({(k, v) for (k, _), v in own.items()}) == len(own)
    assert not {(k, v) for (k, _), v in own.items()} & {(k, national(k, c)) for k, c in own}
