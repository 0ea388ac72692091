from talkloom.cli import main

raise SystemExit(main())
