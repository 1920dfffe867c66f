"""Run the command line."""

import sys

from grainworks.cli import main

sys.exit(main())
