import sys

from folioscan.plans.commands import main

sys.exit(main())
