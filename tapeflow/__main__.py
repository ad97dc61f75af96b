from tapeflow.cli import main

raise SystemExit(main())
