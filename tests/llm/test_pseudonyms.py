import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from waymark.llm import pseudonyms as P

KEY = "k"


def number(key, turn, other):
    return int(hashlib.sha256(f"{key}|{turn}|{other}".encode()).hexdigest()[:15], 16)


def feistel(x, y, high, low, key):
    for turn in range(P.ROUNDS):
        if turn % 2:
            x = (x + number(key, turn, y)) % high
        else:
            y = (y + number(key, turn, x)) % low
    return x, y


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def brute(match, key=KEY):
    """The pseudonym of a card, phone, date, social security number or address of plain
    numbers by plain Python; other matches as they are."""
    if re.fullmatch(P.DATE, match):
        try:
            day = datetime.date.fromisoformat(match) if "-" in match else datetime.datetime.strptime(match, "%m/%d/%Y").date()
        except ValueError:
            return match
        within = (day - datetime.date(2000, 1, 1)).days % 146097
        x, y = feistel(within // 27, within % 27, 5411, 27, key + "date")
        new = day + datetime.timedelta(days=x * 27 + y - within)
        return new.isoformat() if "-" in match else new.strftime("%m/%d/%Y")
    digits = re.sub(r"\D", "", match)
    if re.fullmatch(P.SSN, match):
        area, group, serial = map(int, match.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return match
        x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key + "ssn")
        return f"{x // 99 + 1 + (x // 99 >= 665):03}-{x % 99 + 1:02}-{y + 1:04}"
    if re.fullmatch(P.IPV4, match):
        parts = match.split(".")
        if any(int(n) > 255 or str(int(n)) != n for n in parts):
            return match
        a, b, c, d = map(int, parts)
        x, y = feistel(a * 256 + b, c * 256 + d, 65536, 65536, key + "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(P.CARD, match) and luhn(digits) == 0:
        a = (len(digits) - 2) // 2
        b = len(digits) - 2 - a
        x, y = feistel(int(digits[1 : 1 + a]), int(digits[1 + a : 1 + a + b]), 10**a, 10**b, f"{key}card{len(digits)}")
        body = digits[0] + str(x).zfill(a) + str(y).zfill(b)
        new = body + str((10 - luhn(body + "0")) % 10)
    elif re.fullmatch(P.PHONE, match):
        # area and exchange move within 200 to 999, or within 0 to 199
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        a0, areas = (200, 800) if area >= 200 else (0, 200)
        e0, exchanges = (200, 800) if exchange >= 200 else (0, 200)
        n, low = ((area - a0) * exchanges + exchange - e0) * 10000 + line, exchanges * 100
        x, y = feistel(n // low, n % low, areas * 100, low, key + "phone")
        n = x * low + y
        new = digits[:-10] + f"{n // (exchanges * 10000) + a0:03}{n // 10000 % exchanges + e0:03}{n % 10000:04}"
    else:
        return match
    left = iter(new)
    return "".join(next(left) if c.isdigit() else c for c in match)


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in P.pseudonymise(rows, KEY).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            card = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 13, 15, 18])))
            card += str((10 - luhn(card + "0")) % 10)
            parts += ["word é", rng.choice([card, " ".join(card[i : i + 4] for i in range(0, len(card), 4)), f"+1 ({rng.randrange(100, 1000)}) {rng.randrange(100, 1000)}-{rng.randrange(10000):04}", f"{rng.randrange(1700, 2400)}-{rng.randrange(14):02}-{rng.randrange(33):02}", f"{rng.randrange(1, 13):02}/{rng.randrange(1, 32):02}/{rng.randrange(1900, 2100)}", str(rng.randrange(10**15)), "4" * 30, f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}", ".".join(str(rng.randrange(300)) for _ in range(4)), f"({rng.randrange(300):03}) {rng.randrange(300):03}-0000"])]
        texts.append(" ".join(parts) + ".")
    got = run(spark, texts)
    pattern = re.compile(P.PATTERN.replace(r"\p{L}\p{N}_", r"\w"))
    for i, text in enumerate(texts):
        assert got[i].text == pattern.sub(lambda m: brute(m.group()), text)


def test_formats_links_and_edges(spark):
    texts = [None, "", "No data, 12 apples: 4.0 and 3.", "a.b7@mail.example.com a.b7@mail.example.com", "Mail a.b7@mail.example.com. Then", "10.0.0.255 and 256.1.1.1 and 1.2.3.4.5", "123-45-6789 000-12-3456", "GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32", "4111111111111111", "4111111111111112", "2024-02-30 2024-02-29", "4111111111111111 " * 3000, "x4111111111111111 4111111111111111y é4111111111111111"]
    got = run(spark, texts)
    for i in (0, 1, 2, 9, 12):
        assert got[i].text == texts[i] and got[i].n_private == {}
    one, two = got[3].text.split()
    assert one == two and one != "a.b7@mail.example.com" and re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com", one)
    assert got[4].text == f"Mail {one}. Then"
    addresses = got[5].text.split(" and ")
    assert addresses[1:] == ["256.1.1.1", "1.2.3.4.5"] and addresses[0] != "10.0.0.255" and all(int(x) < 256 for x in addresses[0].split("."))
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} 000-12-3456", got[6].text) and got[6].n_private == {"ssn": 1}
    good, bad = got[7].text.split(", ")
    bare = good.replace(" ", "")
    assert bad == "GB83 WEST 1234 5698 7654 32" and good != texts[7].split(", ")[0] and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert luhn(got[8].text) == 0 and got[8].text[0] == "4" and got[8].text != texts[8]
    assert got[10].text.startswith("2024-02-30 ") and got[10].n_private == {"date": 1}
    assert got[11].text == (got[8].text + " ") * 3000 and got[11].n_private == {"card": 3000}


def test_permutations_and_columns(spark):
    pairs = spark.range(27 * 31).select(P.feistel(F.col("id") % 27, F.floor(F.col("id") / 27), 27, 31, F.lit("p")).alias("s"))
    assert pairs.distinct().count() == 27 * 31
    texts = spark.range(260).select(P.feistel_text(F.concat(F.char(F.col("id") % 26 + 97), F.floor(F.col("id") / 26).cast("string")), F.lit("p")).alias("s"))
    assert texts.distinct().count() == 260
    rows = spark.createDataFrame([(1, "4111111111111111", 5, 6, 7), (1, "4111111111111111", 5, 6, 7), (None, "x", 5, None, 7)], "doc_id long, text string, n_private int, __found int, `a.b` int")
    out = P.pseudonymise(rows, KEY)
    assert sorted(out.columns) == ["__found", "a.b", "doc_id", "n_private", "text"] and out.count() == 3
    assert P.pseudonymise(rows.limit(0), KEY).count() == 0
