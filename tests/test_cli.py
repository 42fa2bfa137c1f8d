import pytest

from surveylens.__main__ import main


def test_cli_help():
    with pytest.raises(SystemExit) as exc:
        main(["--help"])
    assert exc.value.code == 0


def test_cli_requires_arguments():
    with pytest.raises(SystemExit) as exc:
        main([])
    assert exc.value.code != 0
