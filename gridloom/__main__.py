import sys

from gridloom.cli import main

sys.exit(main())
