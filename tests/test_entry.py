import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone():
    """Without the training-data subpackage the engine imports and has its own queries."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name == 'pixelmill.llm' or name.startswith('pixelmill.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'multiscale_features' in e.queries() and not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
