"""hustings.plans"""
