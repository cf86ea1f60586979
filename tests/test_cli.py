import gzip
import subprocess
import sys
from pathlib import Path

from veriflate.cli import main, parse_size
from veriflate.files import Reader, decompress_file
from veriflate.sources.deflate_writer import compress

ROOT = Path(__file__).parent.parent


def call(*args, data=None):
    return subprocess.run([sys.executable, "-m", "veriflate.cli", *map(str, args)], input=data, capture_output=True, cwd=ROOT)


def test_files_and_codes(tmp_path, capsys):
    path = tmp_path / "a.txt.gz"
    path.write_bytes(compress(b"hello") + compress(b" world"))
    assert main([str(path)]) == 0 and (tmp_path / "a.txt").read_bytes() == b"hello world"
    assert main([str(path)]) == 3 and main(["-f", str(path)]) == 0
    assert main(["--verify", "--stats", str(path)]) == 0
    assert "member_count: 2" in capsys.readouterr().err
    assert main(["--output-limit", "5", "-f", str(path)]) == 1
    assert main([str(tmp_path / "none.gz")]) == 3
    assert main([]) == main(["-d", "--compress", "x"]) == main(["--verify", "--compress", "x"]) == main(["--output-limit", "x", str(path)]) == 2
    bad = tmp_path / "bad.gz"
    bad.write_bytes(path.read_bytes()[:-1])
    assert main(["--verify", str(bad)]) == 1
    assert main(["--compress", "-f", "-o", str(path), str(path)]) == 3
    assert main(["-f", str(path)]) == 0
    assert main(["-c", "-o", str(tmp_path / "b.gz"), str(tmp_path / "a.txt")]) == 0
    assert gzip.decompress((tmp_path / "b.gz").read_bytes()) == b"hello world"
    assert parse_size("4 MiB") == 4194304


def test_pipes(tmp_path):
    packed = call("-c", data=b"piped")
    assert packed.returncode == 0 and gzip.decompress(packed.stdout) == b"piped"
    (tmp_path / "p.gz").write_bytes(packed.stdout)
    out = call("-dc", "--stats", tmp_path / "p.gz")
    assert out.stdout == b"piped" and b"MiB/s" in out.stderr


def test_reader(tmp_path):
    data = compress(b"0123456789")
    r = Reader(data)
    assert bytes(r.peek()) == b"0123456789"
    r.consume(4)
    assert r.read(3) == b"456"
    report = r.finish()
    assert (report.member_count, report.decompressed_bytes, report.crc_verified, report.compressed_bytes) == (1, 10, True, len(data))
    assert r.read(5) == b""
    (tmp_path / "x.gz").write_bytes(data)
    assert decompress_file(str(tmp_path / "x.gz"), str(tmp_path / "x")).decompressed_bytes == 10
