"""Rules as DataFrame plans, and the fixpoint loop above them."""
