import sys

from rasterloom.cli import main

sys.exit(main())
