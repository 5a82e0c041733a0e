"""What bin/lockstep hands to spark-submit."""

from lockstep.plans.runner import main

if __name__ == "__main__":
    print(main().state)
