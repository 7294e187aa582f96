"""URL lists of more parts than one index holds."""

import json

from creditgraph.operators import serving


def test_parts_beyond_one_index(spark, tmp_path):
    e = spark.createDataFrame([(i,) for i in range(1, 26)], "id long")
    assert serving.write_url_lists(e, str(tmp_path / "urls"), "https://example.org", per_file=5, max_files=2) == 25
    got = {}
    for f in (tmp_path / "urls" / "index").glob("index=*/*.json"):
        for line in f.read_text().splitlines():
            got.setdefault(f.parent.name, {})[json.loads(line)["part"]] = json.loads(line)["urls"]
    assert got == {"index=0": {0: 5, 1: 5}, "index=1": {2: 5, 3: 5}, "index=2": {4: 5}}
