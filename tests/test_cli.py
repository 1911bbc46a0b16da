"""Command line."""

import json

from sceneloom.__main__ import main


def test_list(capsys):
    assert main(["list", "--pattern", "P22", "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert {"mst_weight", "max_flow_value"} <= {q["name"] for q in found}
    assert main(["list", "--family", "ranking"]) == 0 and "extremum_label\tP09" in capsys.readouterr().out
    assert main(["run", "nothing", "/x"]) == 2
