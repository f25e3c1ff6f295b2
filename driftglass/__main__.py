import sys

from driftglass.cli import main

sys.exit(main())
