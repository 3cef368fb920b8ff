"""URL hosts: IPv6 contents and misleading characters, as the standard parser sees them."""

import random
from urllib.parse import urlparse

from querywarden.operators import inbound as I


def expected(url):
    try:
        parsed = urlparse(url)
        return (url, parsed.netloc) if parsed.scheme in ("http", "https") else ("", "unknown")
    except ValueError:
        return "", "unknown"


def generated(n):
    rnd = random.Random(12)
    group = lambda: rnd.choice(["0", "1", "ab", "FFFF", "12345", "g", "", ""])
    for _ in range(n):
        kind = rnd.randrange(6)
        if kind == 0:
            host = ":".join(group() for _ in range(rnd.randrange(1, 10)))
        elif kind == 1:
            host = "::".join(":".join(rnd.choice("1a0") for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(1, 4)))
        elif kind == 2:
            host = rnd.choice(["::", "1::", "1:2:3:4:5:6:", "::ffff:"]) + ".".join(
                rnd.choice(["0", "1", "255", "256", "01", "9"]) for _ in range(rnd.choice([3, 4, 4, 4, 5])))
        elif kind == 3:
            host = rnd.choice(["v1.x", "vF.a:b", "V1.x", "v.x", "vg.x", "v1.", "1.2.3.4", "fe80::1%eth0", "fe80::1%", "::1%a%b", ""])
        elif kind == 4:
            host = "".join(rnd.choice(["1", ":", "::", "a", ".", "%", "]", "[", "@"]) for _ in range(rnd.randrange(8)))
        else:
            host = ":".join(rnd.choice("0aF") for _ in range(8))
        lead = rnd.choice(["", "", "", "u@", "a@b@", "x", "[]@"])
        tail = rnd.choice(["", "", ":80", ":", "x", "@v1.x", ":80@h"])
        yield f"{rnd.choice(['http', 'HTTPS', 'ftp'])}://{lead}[{host}]{tail}/p?q#f"


def test_hosts_as_the_standard_parser_sees_them(spark):
    urls = [*generated(6000), None, "", "http://plain.example/x", "http://exa℀mple/", "http://a／b/", "http://a：b/", "http://bücher.example:80/",
            "http://u＠x/", "http://ⅷ.example", "http://@:＃@h/", "https://[::1]", "http://[::1", "http://::1]", "http://ａ.example/"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string").repartition(4)
    got = {r.i: (r.url, r.source) for r in I.url_columns(df).collect()}
    want = {i: ("", "unknown") if u is None else expected(u) for i, u in enumerate(urls)}
    assert {i: (urls[i], got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert sum(v[0] != "" and "[" in v[0] for v in want.values()) > 200
