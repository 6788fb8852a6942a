import sys

from kinfold.engine import main

sys.exit(main())
