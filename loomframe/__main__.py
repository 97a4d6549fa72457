import sys

from loomframe.cli import run

sys.exit(run(sys.argv[1:]))
