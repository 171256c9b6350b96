import random

from concord.functions import secrets

PROBES = {
    "access_token=abc123": "access_token=[REDACTED]",
    "client_secret: xyz": "client_secret: [REDACTED]",
    "secret_key=q1": "secret_key=[REDACTED]",
    "/x?refresh_token=abc&a=1": "/x?refresh_token=[REDACTED]",
    "https://ghp_tok@host/x": "https://[REDACTED]@host/x",
    "https://u:p@host/x": "https://[REDACTED]@host/x",
    "Key: temperature": "Key: temperature",
    "total_tokens: 7, key_topic = x": "total_tokens: 7, key_topic = x",
    "Authorization: Bearer ab.c-d": "Authorization: Bearer [REDACTED]",
    "?key=1&Token=2#x": "?key=[REDACTED]&Token=[REDACTED]#x",
}


def test_forms(spark):
    df = spark.createDataFrame([(k,) for k in [*PROBES, None]], "t string")
    assert {r.t: r.shown for r in df.select("t", secrets.redact("t").alias("shown")).collect()} == {**PROBES, None: None}


def test_names(spark):
    df = spark.createDataFrame([({"API-Key": "a", "token": None, "total_tokens": "7", "key_topic": "x", "note": "password=b me", "other": None, "said": 'it is "s3"'},)], "m map<string,string>")
    want = {"API-Key": "[REDACTED]", "token": "[REDACTED]", "total_tokens": "7", "key_topic": "x", "note": "password=[REDACTED] me", "other": None, "said": 'it is "s3"'}
    assert df.select(secrets.redact_keys("m")).first()[0] == want
    got = df.select(secrets.redact_keys("m", ['"s3"', "me"])).first()[0]
    assert got == {**want, "note": "password=[REDACTED] [REDACTED]", "said": "it is [REDACTED]"} | ({} if "other" in got else {})


def test_no_known_secret_is_left(spark):
    rng = random.Random(9)
    known = ["".join(rng.choices("abc$.é", k=rng.randrange(3, 9))) for _ in range(400)] + ["", "abcab", "bcabc"]
    texts = [(k, "".join(rng.choices("abc$.é ", k=rng.randrange(40))) + rng.choice(known) + rng.choice(["", " x "]) + rng.choice(known)) for k in range(10_000)] + [(10_000, None), (10_001, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    shown = {r.id: (r.t, r.shown, r.held) for r in df.select("id", "t", secrets.without(known)("t").alias("shown"), secrets.holds("t", known).alias("held")).collect()}
    real = [s for s in known if s]
    for before, after, held in shown.values():
        assert (before is None) == (after is None)
        if before is not None:
            assert not any(s in part for part in after.split("[REDACTED]") for s in real)
            assert held == any(s in before for s in real) and (held or before == after)
    assert shown[10_000][2] is False
    one = spark.createDataFrame([("xabcabcy",)], "t string").select(secrets.without(known)("t")).first()[0]
    assert one == "x[REDACTED]y"  # two secrets that overlap go as one
