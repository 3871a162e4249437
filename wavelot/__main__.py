import sys

from wavelot.cli import main

sys.exit(main())
