from loomwork.cli import main

main()
