"""The entry without the optional training-data subpackage, or without a package that only it needs."""

import subprocess
import sys

import pytest


@pytest.mark.parametrize("absent", ["regex", "public_tokenizers", "canopyframe.llm", "corpus_pipeline"])
def test_entry_without_optional_packages(absent):
    code = (f"import re, sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), any(re.match(r'op[0-9]+_|pipeline', k) for k in e.queries()))")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, training = done.stdout.split()
    assert int(count) > 150 and training == "False"
