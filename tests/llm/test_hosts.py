"""Suffixes of hosts."""

from pyspark.sql import functions as F

from tidewire.llm import hosts


def test_suffixes_by_rule_and_by_list(spark):
    names = ["a.b.example.com", "example.com", "com", "x.y.gov.au", "y.com.mx", "co.uk", "deep.name.co.uk", "co.ukx", "", "www.shop.ck", "shop.ck", "www.ck", "a.city.kobe.jp", "a.b.kobe.jp", "x.github.io"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, host string")

    def read(suffixes):
        h = F.col("host")
        return [tuple(r) for r in df.orderBy("k").select(hosts.suffix_of(h, suffixes), hosts.domain_of(h, suffixes)).collect()]

    usual = read(hosts.Suffixes())
    assert usual[:9] == [("com", "example.com"), ("com", "example.com"), ("com", "com"), ("gov.au", "y.gov.au"), ("com.mx", "y.com.mx"), ("co.uk", "co.uk"), ("co.uk", "name.co.uk"), ("ukx", "co.ukx"), ("", "")]
    listed = read(hosts.Suffixes(rules=("*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "github.io")))
    assert listed[:9] == usual[:9]
    assert listed[9:] == [("shop.ck", "www.shop.ck"), ("shop.ck", "shop.ck"), ("ck", "www.ck"), ("kobe.jp", "city.kobe.jp"), ("b.kobe.jp", "a.b.kobe.jp"), ("github.io", "x.github.io")]
